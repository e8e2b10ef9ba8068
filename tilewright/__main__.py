"""python -m tilewright ACTION ...: runs an action on the session that spark-submit gives, or on a local one.

Exit codes: 0 done (also where a conversion has nothing to write because all of it is cut away), 1 failed, 2 wrong usage.
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import functions as F

from tilewright import actions
from tilewright.session import local_session


def convert(spark, a) -> int:
    """Convert a job, after saying what of it is not done."""
    stop = False
    for row in actions.check_job(spark, a.job).collect():  # a line for each field of one file at most
        print(f"{row['kind']}: {row['message']}", file=sys.stderr)
        stop |= row["kind"] == "error"
    if stop:
        return 1
    out = actions.convert_job(spark, a.job, a.images, a.references, a.out, a.size, a.linear_rows, a.coast, a.margin_nm * 1.852, a.lakes, a.water, a.black_is_missing)
    done = out.agg(F.count("name").alias("files"), F.sum("bytes").alias("bytes")).first()
    if done["files"]:
        print(f"{done['files']} files, {done['bytes'] / (1 << 20):.1f} MB")
        return 0
    if a.coast or a.lakes:
        print("all of it lies past the cut: nothing was written")
        return 0
    print("error: no tiles were written", file=sys.stderr)
    return 1


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tilewright", description=actions.__doc__)
    kinds = parser.add_subparsers(dest="action", required=True)
    p = kinds.add_parser("convert")
    p.add_argument("job")
    p.add_argument("images", help="a folder or pattern of images")
    p.add_argument("references", help="a folder or pattern of their georeference files")
    p.add_argument("--out", required=True)
    p.add_argument("--size", type=int, default=2048)
    p.add_argument("--coast")
    p.add_argument("--lakes")
    p.add_argument("--water", help="a folder or pattern of correction fields")
    p.add_argument("--margin-nm", type=float, default=3.0)
    p.add_argument("--linear-rows", action="store_true")
    p.add_argument("--black-is-missing", action="store_true", help="exact black leaves a pixel to the next image")
    p = kinds.add_parser("classify")
    p.add_argument("coast")
    p.add_argument("squares", nargs="+")
    p.add_argument("--margin-nm", type=float, default=3.0)
    p = kinds.add_parser("install")
    p.add_argument("built")
    p.add_argument("there")
    p.add_argument("--level", type=int, default=9)
    p = kinds.add_parser("landmarks")
    p.add_argument("gazetteer")
    a = parser.parse_args(argv)
    if "SPARK_ENV_LOADED" in os.environ:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.getOrCreate()
    else:
        spark = local_session()
    if a.action == "convert":
        return convert(spark, a)
    if a.action == "classify":
        out = actions.classify(spark, spark.createDataFrame([(s,) for s in a.squares], "name string"), a.coast, a.margin_nm * 1.852)
    elif a.action == "install":
        out = actions.install(spark, a.built, a.there, a.level)
    else:
        out = actions.landmarks(spark, a.gazetteer)
    out.show(1000, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
