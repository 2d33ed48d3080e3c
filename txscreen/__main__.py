"""The screening job with its parameters as arguments."""

import argparse

from pyspark.sql import SparkSession

from txscreen.operators import sampling
from txscreen.operators.training import Forest
from txscreen.plans import screening
from txscreen.sources import job_folder


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="txscreen", description="Screen a table of transactions.")
    parser.add_argument("path", help="input folder or file, any URI Spark can read")
    parser.add_argument("--format", choices=("csv", "parquet"), default="csv")
    parser.add_argument("--fraction", type=float, help="work on a sample of this size")
    parser.add_argument("--sampling", choices=("hash", "random"), default="hash",
                        help="the sample by a hash of the row, or drawn from the files as they lie")
    parser.add_argument("--malformed", choices=("fail", "account"), default="fail",
                        help="malformed CSV rows: fail, or go on without them and list them")
    parser.add_argument("--trees", type=int, default=50)
    parser.add_argument("--seed", type=int, default=67)
    parser.add_argument("--partitions", type=int, default=Forest.partitions,
                        help="partitions of the training rows; part of the model, like the seed")
    parser.add_argument("--split", choices=("hash", "random"), default="hash")
    parser.add_argument("--invalid", choices=("error", "keep"), default="error",
                        help="null or unseen categories: fail, or keep as one of their own")
    parser.add_argument("--infer-schema", action="store_true", help="let Spark find CSV types")
    parser.add_argument("--unique", action="store_true", help="explore without exact copies")
    parser.add_argument("--all-senders", action="store_true",
                        help="with --fraction, figures of senders from the whole input")
    parser.add_argument("--output", help="write each result table to a folder below this one")
    args = parser.parse_args(argv)
    if args.malformed == "account":
        if args.format != "csv" or args.infer_schema or args.sampling == "random":
            parser.error("--malformed account is for CSV of declared types and hash samples")
    return args


def main(argv: list[str] | None = None) -> None:
    args = arguments(argv)
    spark = SparkSession.builder.appName("txscreen").getOrCreate()
    with job_folder(spark):
        whole = args.fraction is not None and args.all_senders
        if args.malformed == "account":
            every, lists = screening.load_with_account(spark, args.path)
            tx = every
            if args.fraction is not None:
                tx = sampling.fraction_sample(every, args.fraction, args.seed)
        else:
            source = {"file_format": args.format, "infer_schema": args.infer_schema}
            drawn = {"fraction": args.fraction, "seed": args.seed, "by_hash": args.sampling == "hash"}
            tx, lists = screening.load(spark, args.path, **drawn, **source), {}
            every = screening.load(spark, args.path, **source) if whole else None
        tables = lists | screening.report(
            tx,
            Forest(args.trees, args.seed, args.invalid, args.partitions),
            random_seed=args.seed if args.split == "random" else None,
            unique=args.unique,
            senders_of=every if whole else None,
        )
        for name, table in tables.items():
            if args.output:
                table.write.mode("overwrite").parquet(f"{args.output}/{name}")
            else:
                print(name)
                table.show(truncate=False)


if __name__ == "__main__":
    main()
