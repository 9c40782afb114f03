"""Command line for spark-submit: ``python -m tabscore {train,score,score-models} ...``.

Thin argument parsing over :mod:`tabscore.plans.jobs`; the session comes from
spark-submit (or ``--master`` for local runs).  Exit status is non-zero when
the job fails.
"""

from __future__ import annotations

import argparse
import datetime as _dt
import importlib
import json
import sys

from tabscore.operators.pyscore import BasePredictor
from tabscore.operators.runlog import ModelStore, RunLog, RunRecord, generate_version
from tabscore.operators.scoring import OutputLayout
from tabscore.plans import jobs
from tabscore.session import build_session
from tabscore.sources.files import load_input


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tabscore")
    p.add_argument("--master", default=None, help="only for local runs; spark-submit sets it")
    sub = p.add_subparsers(dest="command", required=True)

    def common(sp, one_model=True):
        sp.add_argument("--input", help="CSV/Parquet/JSON path (format by extension)")
        sp.add_argument("--table", help="catalog table, used when no --input is given")
        sp.add_argument("--model-store", required=True, help="registry table path")
        sp.add_argument("--feature-name", default="default")
        if one_model:
            sp.add_argument("--model-name", required=True)
        sp.add_argument("--run-log", help="run log table path")
        sp.add_argument("--commit-hash", help="commit of the code that runs, for the run log")

    t = sub.add_parser("train", help="split, scale, fit, evaluate, log and register a model")
    common(t)
    t.add_argument("--features", required=True, help="comma-separated feature columns")
    t.add_argument("--label", default="target")
    t.add_argument("--key", required=True, help="unique row key for the split")
    t.add_argument("--test-size", type=float, default=0.2)
    t.add_argument("--max-iter", type=int, default=1000)
    t.add_argument("--C", type=float, default=1.0)
    t.add_argument("--version", default=None)
    t.add_argument("--split-mode", choices=("exact", "approx"), default="exact")
    t.add_argument("--hash", choices=("md5", "xxhash64"), default="md5",
                   help="split hash: md5 (reproducible elsewhere) or xxhash64 (cheaper, Spark-only)")

    t.add_argument("--date-column", help="train on the SQL extract of --table: labelled rows of a date window")
    t.add_argument("--start-date")
    t.add_argument("--end-date")
    t.add_argument("--sample-fraction", type=float, default=1.0)
    t.add_argument("--on-invalid", choices=("error", "skip"), default="error")

    def output(sp):
        sp.add_argument("--output", help="output path (format by extension)")
        sp.add_argument("--output-table", help="output table, used when no --output is given")
        sp.add_argument("--threshold", type=float, default=0.5)
        sp.add_argument("--on-invalid", choices=("error", "skip", "null"), default="error")

    s = sub.add_parser("score", help="score a table with a registered model or a user's predictor")
    common(s)
    output(s)
    s.add_argument("--version", default="latest")
    s.add_argument("--predictor", help="module:Class of a predictor, in place of the registered model")
    s.add_argument("--id-col", help="write this column, the label, probability and run time, not the input columns")
    s.add_argument("--label-col", default="predicted_label")
    s.add_argument("--probability-col", default="probability")
    s.add_argument("--timestamp-col", default="scored_at")
    s.add_argument("--run-timestamp", help="ISO time of the run for --timestamp-col")
    s.add_argument("--day", help="score one day of --date-column and replace it in the output")
    s.add_argument("--date-column")

    m = sub.add_parser("score-models", help="score a table with several registered models in one pass")
    common(m, one_model=False)
    output(m)
    m.add_argument("--model-names", required=True, help="comma-separated; each gets a status of its own")
    m.add_argument("--keep", required=True, help="comma-separated input columns to keep")
    return p


def _predictor(spec: str):
    """An instance of ``module:Class``."""
    module, _, name = spec.partition(":")
    cls = getattr(importlib.import_module(module), name)
    if not (isinstance(cls, type) and issubclass(cls, BasePredictor)):
        raise SystemExit(f"{spec} is not a predictor class")
    return cls()


def _train(spark, args, store, log, version) -> dict:
    config = {"test_size": args.test_size, "split_mode": args.split_mode,
              "hyperparameters": {"max_iter": args.max_iter, "C": args.C}}
    features = args.features.split(",")
    settings = dict(name=args.model_name, version=version, run_log=log, store=store, hash_algorithm=args.hash,
                    on_invalid=args.on_invalid)
    if args.date_column:
        if not (args.table and args.start_date and args.end_date):
            raise SystemExit("--date-column needs --table, --start-date and --end-date")
        res = jobs.train_from_extract(spark, args.table, features, args.label, args.date_column, args.start_date, args.end_date,
                                      args.key, sample_fraction=args.sample_fraction, config=config, **settings)
    else:
        res = jobs.train_from_config(load_input(spark, args.input, args.table), features, args.label, args.key, config=config, **settings)
    return {"status": "ok", "model": args.model_name, "version": version, "metrics": res.metrics}


def _score(spark, args, store, log) -> dict:
    where = dict(input_path=args.input, table=args.table, output_path=args.output, output_table=args.output_table,
                 on_invalid=args.on_invalid, run_log=log)
    if args.predictor:
        _, rows = jobs.predictor_score_job(spark, _predictor(args.predictor), **where)
        return {"status": "ok", "model": args.predictor, "rows": rows}
    model = store.load(args.model_name, args.version)
    if args.day:
        _, rows = jobs.score_day_job(spark, model, date_column=args.date_column, day=args.day, threshold=args.threshold, **where)
    else:
        run = _dt.datetime.fromisoformat(args.run_timestamp) if args.run_timestamp else None
        layout = OutputLayout(args.id_col, args.label_col, args.probability_col, args.timestamp_col, run) if args.id_col else None
        _, rows = jobs.score_job(spark, model, threshold=args.threshold, layout=layout, **where)
    return {"status": "ok", "model": args.model_name, "version": model.version, "rows": rows}


def main(argv: list[str] | None = None, spark=None) -> dict:
    args = _parser().parse_args(argv)
    if args.command != "train" and not (args.output or args.output_table):
        raise SystemExit(f"{args.command} needs --output or --output-table")
    spark = spark or build_session(args.master, app=f"tabscore-{args.command}")
    store = ModelStore(spark, args.model_store, args.feature_name)
    version = getattr(args, "version", None) or generate_version()
    log = RunLog(spark, args.run_log, run_id=version) if args.run_log else None
    if log is not None:
        log.log_run(RunRecord("cli", version, "training" if args.command == "train" else "prediction", args.commit_hash))
    if args.command == "train":
        return _train(spark, args, store, log, version)
    if args.command == "score":
        return _score(spark, args, store, log)
    models = jobs.score_models_job(spark, store, args.model_names.split(","), keep=args.keep.split(","), input_path=args.input,
                                   table=args.table, output_path=args.output, output_table=args.output_table,
                                   threshold=args.threshold, on_invalid=args.on_invalid)
    return {"status": "ok" if all(s["status"] == "ok" for s in models.values()) else "error: not every model was scored",
            "models": models}


if __name__ == "__main__":
    try:
        result = main()
        print(json.dumps(result))
        sys.exit(0 if result["status"] == "ok" else 1)
    except Exception as exc:  # report and fail the submit
        print(json.dumps({"status": f"error: {exc}"}), file=sys.stderr)
        sys.exit(1)
