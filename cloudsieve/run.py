"""Command line: fit and evaluate a dataset folder and write its results."""

from __future__ import annotations

import argparse
import json
import time

from .config import Config
from .session import get_spark


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__)
    d = Config()
    for name, value in d.to_dict().items():
        if name in ("extra", "local_radii"):
            continue
        flag = "--" + name.replace("_", "-")
        if isinstance(value, bool):
            p.add_argument(flag, action="store_true", default=value)
        else:
            p.add_argument(flag, type=type(value), default=value)
    p.add_argument("--local-radii", type=lambda s: tuple(float(x) for x in s.split(",")), default=d.local_radii)
    p.add_argument("--develop", type=int, default=0, metavar="FOLDS",
                   help="score pseudo-tests of that many held-out folds and write their records instead")
    p.add_argument("--classes", default="", help="comma-separated categories (all by default)")
    p.add_argument("--out", default="results")
    p.add_argument("--tag", default="run")
    return p


def config_of(args: argparse.Namespace) -> Config:
    known = Config().to_dict()
    return Config(**{k: v for k, v in vars(args).items() if k in known})


def main(argv: list[str] | None = None) -> None:
    from .plans.benchmark import develop_files, results_table, run_files, sample_records
    from .sources.results import write_result_csv, write_scores
    args = parser().parse_args(argv)
    cfg = config_of(args)
    spark = get_spark(f"cloudsieve {args.tag}")
    classes = args.classes.split(",") if args.classes else None
    base = f"{args.out}/{args.tag}-s{cfg.seed}_{cfg.dataset}_{time.strftime('%Y%m%d-%H%M%S')}"
    if args.develop:
        write_scores(develop_files(spark, cfg, args.develop, classes).withColumnRenamed("unit", "category"), f"{base}_dev")
        return
    run = run_files(spark, cfg, classes)
    names = sorted(r["metric"] for r in run.metrics.select("metric").distinct().collect())
    write_result_csv(results_table(run.metrics, names), f"{base}.csv")
    write_scores(sample_records(run.evaluation, cfg.seed, cfg.dataset), f"{base}_scores")
    settings = spark.createDataFrame([(json.dumps(cfg.to_dict()),)], "value string")
    settings.coalesce(1).write.mode("overwrite").text(f"{base}_config")
    table = results_table(run.metrics, ["o_auroc", "p_auroc", "p_aupr"])
    for row in table.orderBy("category").toLocalIterator():
        print(" ".join(f"{v:.4f}" if isinstance(v, float) else str(v) for v in row))


if __name__ == "__main__":
    main()
