"""Command line: normalize, inspect, formats."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.catalogue import collapse
from .plans.pipeline import normalize
from .sources import readers, sinks
from .sources.errors import DatasetError
from .sources.mapping import Mapping, applied, load_config, merged, ranked_names
from .sources.tables import kept


def session() -> SparkSession:
    return SparkSession.builder.appName("lindero").getOrCreate()


def run_normalize(spark: SparkSession, a: argparse.Namespace, catalogue: DataFrame | None = None) -> dict:
    options = merged(load_config(a.config) if a.config else {}, {k: v for k, v in vars(a).items() if k not in ("config", "command", "run")})
    found = readers.read_table(spark, options["input"], options.get("format"), **{k: options[k] for k in ("encoding", "delimiter", "sheet", "header_row", "table") if k in options})
    keep = options.get("keep")
    m = Mapping(options.get("address"), options.get("parts") or [], lat=options.get("lat"), lon=options.get("lon"), municipality=options.get("municipality"), row_id=options.get("row_id"), keep=None if keep in (None, "all") else [] if keep == "none" else keep.split(",")).resolve(found.df.columns)
    df = found.df.limit(options["limit"]) if options.get("limit") else found.df
    rows = applied(df, m).withColumn("row_id_", F.monotonically_increasing_id())
    docs = catalogue if catalogue is not None else collapse(spark.read.parquet(options["catalogue"]))
    inside = rows.where(~F.col("outside"))
    result = normalize(inside.select(F.col("row_id_").alias("row_id"), "raw"), docs, threshold=options.get("threshold", 0.73), delta=options.get("ambiguity_delta", 0.0), min_struct=options.get("min_struct", 0.6))
    joined = rows.drop("raw").join(result, rows.row_id_ == result.row_id, "left")
    status = F.when(F.col("outside"), "FUERA_DE_AREA").otherwise(F.col("estado"))
    if options.get("on_error") == "raise":
        status = F.when(status == "ERROR", F.raise_error(F.col("motivo"))).otherwise(status)
    # Written once, so that sorting and counting match nothing again.
    done = kept(joined.withColumn("estado", status).drop("row_id", "outside"), "normalized")
    path = options.get("output") or sinks.default_path(options["input"])
    sinks.write(done.orderBy("row_id_").drop("row_id_"), path)
    counts = {r["estado"]: r["count"] for r in done.groupBy("estado").count().collect()}
    return {"output": path, "rows": sum(counts.values()), "by_status": counts, "warnings": found.warnings}


def run_inspect(spark: SparkSession, a: argparse.Namespace) -> dict:
    f = readers.read_table(spark, a.input, a.format, encoding=a.encoding, delimiter=a.delimiter, sheet=a.sheet, header_row=a.header_row, table=a.table)
    return {"format": f.fmt, "encoding": f.encoding, "delimiter": f.delimiter, "header_row": f.header_row, "sheets": f.sheets, "columns": f.df.columns, "address_candidates": ranked_names(f.df.columns), "preview": [r.asDict() for r in f.df.limit(5).collect()], "rows": f.df.count(), "warnings": f.warnings}


def run_formats(spark: SparkSession, a: argparse.Namespace) -> dict:
    return {"read": sorted(readers.READERS), "write": sorted(sinks.WRITERS), "extensions": readers.EXTENSIONS}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lindero")
    sub = p.add_subparsers(dest="command", required=True)
    for name, run in (("normalize", run_normalize), ("inspect", run_inspect), ("formats", run_formats)):
        s = sub.add_parser(name)
        s.set_defaults(run=run)
        if name == "formats":
            continue
        s.add_argument("input")
        for option in ("--format", "--encoding", "--delimiter", "--sheet", "--table"):
            s.add_argument(option)
        s.add_argument("--header-row", type=int)
        if name == "normalize":
            for option in ("--config", "--catalogue", "--output", "--address", "--lat", "--lon", "--municipality", "--row-id", "--keep"):
                s.add_argument(option)
            s.add_argument("--parts", nargs="*")
            s.add_argument("--limit", type=int)
            s.add_argument("--on-error", choices=("row", "raise"))
            for option in ("--threshold", "--ambiguity-delta", "--min-struct"):
                s.add_argument(option, type=float)
    return p


def main(argv: list[str] | None = None, make_session: Callable[[], SparkSession] = session) -> int:
    """0: done; 2: wrong use; 3: reading or writing failed; 4: every row failed; 130: stopped."""
    a = parser().parse_args(argv)
    try:
        out = a.run(make_session(), a)
    except DatasetError as e:
        print(readers.redact(str(e)), file=sys.stderr)
        return e.exit_code
    except KeyboardInterrupt:
        return 130
    print(json.dumps(out, ensure_ascii=False, default=str, indent=2))
    by = out.get("by_status") or {}
    return 4 if by and set(by) == {"ERROR"} else 0


if __name__ == "__main__":
    sys.exit(main())
