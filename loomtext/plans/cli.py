"""Command line: ``python -m loomtext.plans.cli --config FILE STEP...`` with the steps in their fixed order."""

from __future__ import annotations

import argparse
from collections.abc import Callable, Sequence

from pyspark.sql import SparkSession

from loomtext.plans.config import load_config, names, require, section
from loomtext.plans.crossval import run_crossval
from loomtext.plans.predictive import run_predictive
from loomtext.plans.report import run_report
from loomtext.plans.text_corpus import run_text
from loomtext.session import build_session
from loomtext.streaming.transcribe import transcribe_new


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="loomtext")
    # The flags' names are the public interface.
    p.add_argument("--config", required=True)
    for step in ("asr", "predictive", "text", "cv", "report"):
        p.add_argument(f"--{step}", action="store_true")
    p.add_argument("--labels", nargs="*")
    p.add_argument("--cap-per-label", type=int)
    p.add_argument("--force-asr-jsonl", action="store_true")
    p.add_argument("--skip-asr", action="store_true")
    p.add_argument("--methods", nargs="*")
    p.add_argument("--reuse-folds", action="store_true")
    p.add_argument("--outdir", default="report")
    p.add_argument("--draw-boundary", action="store_true")
    p.add_argument("--boundary-scope", choices=("cleaned", "both"), default="cleaned")
    p.add_argument("--skip-combined", action="store_true")
    p.add_argument("--skip-missing", action="store_true", default=None)
    return p


def run_asr(spark: SparkSession, config: dict, load: Callable | None, labels: Sequence[str] | None, cap: int | None) -> None:
    """Transcribes what is new in the audio tree, batch by batch; the recogniser is the caller's."""
    if load is None:
        raise ValueError("the asr step needs a recogniser")
    own = section(config, "asr")
    transcribe_new(spark, require(own, "data_root", "asr."), require(own, "output_csv", "asr."), load, labels=labels, cap=cap, batch=own.get("files_per_batch"))


def main(argv: Sequence[str] | None = None, *, spark: SparkSession | None = None, recogniser: Callable | None = None, encoders: dict | None = None) -> None:
    """Unknown arguments are left aside; without any step there is nothing to do, which is an error."""
    args, _ = parser().parse_known_args(argv)
    if not (args.asr or args.predictive or args.text or args.cv or args.report):
        raise SystemExit("no step was named")
    config = load_config(args.config)
    spark = spark or build_session()
    if args.asr and not args.skip_asr:
        run_asr(spark, config, recogniser, names(args.labels), args.cap_per_label)
    if args.predictive:
        run_predictive(spark, config)
    if args.text:
        run_text(spark, config, force_transcripts=args.force_asr_jsonl, skip_transcripts=args.skip_asr, skip_missing=args.skip_missing)
    if args.cv:
        run_crossval(spark, config, methods=names(args.methods), reuse_folds=args.reuse_folds, encoders=encoders)
    if args.report:
        run_report(spark, config, args.outdir, boundary=args.draw_boundary, boundary_scope=args.boundary_scope, skip_combined=args.skip_combined)


if __name__ == "__main__":
    main()
