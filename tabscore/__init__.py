"""tabscore: tabular model training, scoring and evaluation as Spark DataFrame jobs.

Everything here takes and returns DataFrames.  The only values that reach the
driver are bounded by construction: fitted parameters (one row per feature),
scalar metrics, histogram bins of a fixed count and schema metadata.

The names below are the everyday surface; the modules hold the rest.
"""

__version__ = "0.1.0"

from tabscore.functions.linear import LinearModel
from tabscore.operators.metrics import binary_metrics, evaluate, evaluate_many
from tabscore.operators.multi import model_status, score_ensemble, score_many
from tabscore.operators.profile import describe, describe_wide, head, value_counts
from tabscore.operators.pyscore import ArtifactPredictor, BasePredictor, score_with_predictor, score_with_udf
from tabscore.operators.runlog import ArtifactStore, ModelKey, ModelStore, RunLog, RunRecord, generate_version
from tabscore.operators.sampling import keyed_sample, random_sample, split
from tabscore.operators.scaling import fit_scaler, transform
from tabscore.operators.scoring import OutputLayout, score, score_proba, score_vector, shape_output
from tabscore.operators.validate import InputSchema, SchemaValidationError, quarantine
from tabscore.plans.jobs import (score_day_job, score_job, score_models_job, train_from_config,
                                 train_from_extract, train_job)
from tabscore.session import build_session, cluster_conf
from tabscore.sources.files import load_input, read_file, write_output

__all__ = [
    "LinearModel", "binary_metrics", "evaluate", "evaluate_many", "model_status", "score_ensemble",
    "score_many", "describe", "describe_wide", "head", "value_counts", "ArtifactPredictor", "BasePredictor", "OutputLayout",
    "score_with_predictor", "score_with_udf", "ArtifactStore", "ModelKey", "ModelStore", "RunLog", "RunRecord", "generate_version",
    "keyed_sample", "random_sample", "split", "fit_scaler", "transform", "score", "score_proba",
    "score_vector", "shape_output", "InputSchema", "SchemaValidationError", "quarantine", "score_job",
    "score_models_job", "train_from_config", "train_job", "build_session", "cluster_conf",
    "load_input", "read_file", "write_output",
]
