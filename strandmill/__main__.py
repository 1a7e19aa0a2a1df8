"""Command line: `python -m strandmill sketch | dist | stats`.

`sketch` writes an index folder or exchange JSON, `dist` searches or compares, `stats` describes an index.  The session comes
from spark-submit or, without it, runs on `--threads` local cores.
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from strandmill.functions.hashing import ALGORITHMS
from strandmill.operators.index import index_detail, index_summary, is_index, open_index, write_index
from strandmill.operators.search import compare, search
from strandmill.operators.sketch import collapse, sketch
from strandmill.sources.exchange import read_exchange, write_exchange
from strandmill.sources.fastx import read_fastx
from strandmill.sources.results import print_results, write_results


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="strandmill", description="Sketches sequences and searches sketches for containment.")
    out.add_argument("-t", "--threads", type=int, default=1, help="cores of a local session")
    out.add_argument("-f", "--force", action="store_true", help="overwrite output")
    out.add_argument("-s", "--silent", action="store_true", help="no messages")
    commands = out.add_subparsers(dest="command", required=True)
    one = commands.add_parser("sketch", help="sketch files, folders or .list files")
    one.add_argument("input", nargs="+")
    one.add_argument("-o", "--output", required=True)
    one.add_argument("-k", "--kmer-size", type=int, default=21)
    one.add_argument("--fscale", type=int)
    one.add_argument("--nmax", type=int)
    one.add_argument("--format", choices=("index", "exchange"), default="index")
    one.add_argument("--algorithm", choices=ALGORITHMS, default="default")
    one.add_argument("--singleton", action="store_true", help="a sketch for each record")
    two = commands.add_parser("dist", help="search an index, or compare with exchange files")
    two.add_argument("-i", "--input", required=True, help="sequences")
    two.add_argument("-d", "--database", nargs="+", required=True, help="one index or any number of exchange files")
    two.add_argument("-o", "--output")
    two.add_argument("-c", "--cutoff", type=float, default=0.0)
    three = commands.add_parser("stats", help="describe an index")
    three.add_argument("-i", "--input", required=True)
    three.add_argument("-s", "--short", action="store_true")
    return out


def distances(spark: SparkSession, source: str, databases: list[str], cutoff: float) -> DataFrame:
    """Query sketches, one for each file, searched in one index or compared with the collapsed sketches of exchange files."""
    if len(databases) == 1 and is_index(spark, databases[0]):
        index = open_index(spark, databases[0])
        query = sketch(read_fastx(spark, source, index.k, check_extension=False), index.k, index.fscale, algorithm=index.algorithm)
        return search(index, query, cutoff)
    target = read_exchange(spark, databases)
    query = sketch(read_fastx(spark, source, target.k, check_extension=False), target.k, target.fscale, algorithm=target.algorithm)
    return compare(collapse(query), collapse(target), cutoff)


def run(spark: SparkSession, asked: argparse.Namespace) -> None:
    mode = "overwrite" if asked.force else "errorifexists"
    if asked.command == "sketch":
        records = read_fastx(spark, asked.input, asked.kmer_size)
        made = sketch(records, asked.kmer_size, asked.fscale, asked.nmax, asked.algorithm, asked.singleton)
        (write_index if asked.format == "index" else write_exchange)(made, asked.output, mode)
    elif asked.command == "dist":
        found = distances(spark, asked.input, asked.database, asked.cutoff)
        if asked.output:
            write_results(found, asked.output, mode)
        else:
            print_results(found)
    else:
        index = open_index(spark, asked.input)
        for row in (index_summary if asked.short else index_detail)(index).toLocalIterator():
            print(*row, sep="\t")


def main(arguments: list[str] | None = None) -> None:
    asked = parser().parse_args(arguments)
    builder = SparkSession.builder.appName("strandmill").config("spark.ui.showConsoleProgress", str(not asked.silent).lower())
    if SparkSession.getActiveSession() is None and "PYSPARK_GATEWAY_PORT" not in os.environ:  # else spark-submit sets the master
        builder = builder.master(f"local[{asked.threads}]")
    spark = builder.getOrCreate()
    if asked.silent:
        spark.sparkContext.setLogLevel("ERROR")
    try:
        run(spark, asked)
    except (ValueError, OSError, AnalysisException) as error:
        parser().error(str(error))


if __name__ == "__main__":
    main(sys.argv[1:])
