"""python -m loomline preprocess|index|ask|check: the plans from a command line."""
from __future__ import annotations

import argparse

from pyspark.sql import SparkSession


def main() -> None:
    p = argparse.ArgumentParser(prog="loomline")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("preprocess", help="one consolidated text of a directory")
    a.add_argument("input"), a.add_argument("output"), a.add_argument("-a", "--aggressive", action="store_true"), a.add_argument("-r", "--recursive", action="store_true"), a.add_argument("--no-images", action="store_true"), a.add_argument("--no-tables", action="store_true")
    a = sub.add_parser("index", help="chunks, statistics and retrieval index of a directory")
    a.add_argument("input"), a.add_argument("output"), a.add_argument("--strategy", default="multimodal_aware"), a.add_argument("--limit", type=int), a.add_argument("--no-images", action="store_true"), a.add_argument("--no-tables", action="store_true")
    a = sub.add_parser("ask", help="answer questions from an index")
    a.add_argument("index"), a.add_argument("question", nargs="*", help="none: a chat"), a.add_argument("--url", help="a model's HTTP service"), a.add_argument("--model", default="mistral:7b")
    a = sub.add_parser("check", help="whether a directory has documents, and a model's service answers")
    a.add_argument("input"), a.add_argument("--url")
    args = p.parse_args()
    spark = SparkSession.builder.appName("loomline").getOrCreate()
    if args.command == "preprocess":
        from .plans.preprocess import Preprocessing

        Preprocessing(args.recursive, args.aggressive, not args.no_images, not args.no_tables).run(spark, args.input, args.output).show(truncate=False)
    elif args.command == "index":
        from .plans.indexing import Indexing
        from .sources.files import Loader

        Indexing(args.strategy, loader=Loader(not args.no_images, not args.no_tables), limit=args.limit).run(spark, args.input, args.output).show(truncate=False)
    elif args.command == "check":
        from .plans.rag import HttpModel
        from .sources.files import scan_directory

        scan_directory(spark, args.input).groupBy("type").count().show()
        if args.url:
            print("model:", "answers" if HttpModel(args.url).healthy() else "does not answer")
    else:
        from .operators import vectors
        from .plans.rag import Answering, ExtractiveModel, HttpModel

        chunks = spark.read.parquet(f"{args.index}/chunks").selectExpr("content", "name as file_name", "chunk_index")
        answering = Answering(vectors.store(chunks, vectors.hashing_embedding()), model=HttpModel(args.url, args.model) if args.url else ExtractiveModel())
        if not args.question:
            answering.chat()
        for q in args.question:
            r = answering.answer(q)
            print(f"{q}\n{r.answer}\n({r.confidence:.2f})\n")


if __name__ == "__main__":
    main()
