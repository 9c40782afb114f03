"""Publishing a written folder under its final name, once.

Spark's ``errorifexists`` looks first and writes later, so two writers can
both pass it and end up in one folder.  A folder that was written aside and
is then renamed cannot: of several writers, one rename makes the final folder
and the others find it there.
"""

from __future__ import annotations

from pyspark.sql import SparkSession


def path_part(value: str) -> str:
    """``value`` as a partition folder's value, escaped as Spark escapes and reads it."""
    if not value:
        raise ValueError("an empty name cannot name a folder")
    plain = lambda c: c.isalnum() or c in "._-" or ord(c) > 127
    return "".join(c if plain(c) else f"%{ord(c):02X}" for c in value)


def publish_folder(spark: SparkSession, written: str, final: str) -> bool:
    """Rename ``written`` to ``final``; False when ``final`` exists, whoever made it.

    ``written`` should have a name of its own that starts with ``_``: a file
    system that moves a folder *into* an existing one (HDFS, local) then
    leaves something that readers of ``final`` do not see, and that is
    removed here.  The rename is atomic on HDFS and POSIX file systems.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path
    source, target = path(written), path(final)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(target):
        fs.delete(source, True)
        return False
    fs.mkdirs(target.getParent())
    moved = fs.rename(source, target)
    inside = path(target, source.getName())
    if fs.exists(inside):
        fs.delete(inside, True)
        return False
    if not moved and not fs.exists(target):
        raise OSError(f"could not rename {written} to {final}")
    if not moved:
        fs.delete(source, True)
    return moved
