"""Command line over a corpus folder: ingest, phrase, fuzzy, dictionary, compare, bfs, dfs.

    python -m quillspan.cli CORPUS ingest --text FILE --meta FILE
    python -m quillspan.cli CORPUS phrase "some words" --limit 50
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions import text as T
from quillspan.operators import compare, corpus, graph, search
from quillspan.sources import readers


def build_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quillspan", description="Document corpus index on Spark")
    p.add_argument("corpus", help="folder of the corpus tables")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("init")
    ingest = sub.add_parser("ingest")
    ingest.add_argument("--text", required=True)
    ingest.add_argument("--meta", required=True)
    for name, limit in (("phrase", 50), ("fuzzy", 20)):
        q = sub.add_parser(name)
        q.add_argument("query")
        q.add_argument("--limit", type=int, default=limit)
    sub.add_parser("dictionary").add_argument("keywords", nargs="+")
    c = sub.add_parser("compare")
    c.add_argument("left")
    c.add_argument("right")
    for name in ("bfs", "dfs"):
        g = sub.add_parser(name)
        g.add_argument("start")
        g.add_argument("--edge-type")
        if name == "bfs":
            g.add_argument("--depth", type=int, default=3)
    return p


def _print(df: DataFrame) -> None:
    for r in df.toLocalIterator():
        row = r.asDict()
        if row.get("score") is not None:
            row["score"] = round(row["score"], 6)
        print(json.dumps(row, ensure_ascii=False))


def run(spark: SparkSession, args: argparse.Namespace) -> None:
    at = args.corpus.rstrip("/")
    read = lambda name: spark.read.parquet(f"{at}/{name}")
    if args.command == "init":
        for name, empty in readers.empty_tables(spark).items():
            empty.write.mode("ignore").parquet(f"{at}/{name}")
        print(at)
    elif args.command == "ingest":
        one = readers.text_with_metadata(spark, args.text, args.meta).withColumn("metadata_json", T.stable_json("metadata_json"))
        found = corpus.add_witnesses(one).cache()
        new = found.join(read("witness").select("witness_id"), "witness_id", "left_anti").cache()
        new.count()
        segs = corpus.segments(new)
        segs.write.mode("append").parquet(f"{at}/segment")
        corpus.postings(segs, "segment_id").select("gram", "segment_id").write.mode("append").parquet(f"{at}/gram")
        new.drop("segments").write.mode("append").parquet(f"{at}/witness")
        print(found.first()["witness_id"])
    elif args.command in ("phrase", "fuzzy"):
        q = spark.createDataFrame([(0, args.query)], "query_id int, text string")
        segs = read("segment")
        find = search.search_phrase if args.command == "phrase" else search.search_fuzzy
        hits = find(segs, q, "query_id", limit=args.limit).join(segs.select("witness_id", "ordinal", "segment_id", "text"), ["witness_id", "ordinal"])
        _print(hits.select("witness_id", "segment_id", "ordinal", "score", "text").orderBy(F.desc("score"), "witness_id", "ordinal"))
    elif args.command == "dictionary":
        segs = read("segment")
        hits = search.dictionary_scan(segs, args.keywords).join(segs.select("witness_id", "ordinal", "segment_id", "text"), ["witness_id", "ordinal"], "left")
        for keyword in args.keywords:
            own = hits.filter((F.col("keyword") == keyword) & F.col("witness_id").isNotNull())
            print(json.dumps({"keyword": keyword, "hits": own.count()}, ensure_ascii=False))
            _print(own.select("witness_id", "segment_id", "ordinal", F.lit(1.0).alias("score"), "text").orderBy("witness_id", "ordinal"))
    elif args.command == "compare":
        pairs = spark.createDataFrame([(args.left, args.right)], "left string, right string")
        segs = read("segment").filter(F.col("witness_id").isin(args.left, args.right))
        _print(compare.compare_witnesses(compare.profiles(segs, "witness_id"), pairs, "witness_id"))
    elif args.command == "bfs":
        starts = spark.createDataFrame([(args.start,)], "node string")
        _print(graph.bfs(read("edge"), starts, args.depth, args.edge_type).select("node", "depth").orderBy("depth", "node"))
    else:
        _print(graph.dfs_preorder(read("edge"), args.start, args.edge_type).orderBy("position").select("node"))


def main(argv: list[str] | None = None) -> None:
    args = build_parser().parse_args(argv)
    spark = SparkSession.builder.appName("quillspan").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    run(spark, args)


if __name__ == "__main__":
    main()
