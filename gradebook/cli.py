"""Command-line front end over the operators (reports only; no model calls).

    python -m gradebook.cli convert  --csv raw.csv --questions out/q --references out/ref \
                                     [--field-header H --task-header H]
    python -m gradebook.cli show     --judgments DIR --questions Q --mode {single,pairwise-all,
                                     pairwise-baseline,pairwise-each} [--baseline M] [--label L ...]
                                     [--models M ...] [--iid TAG] --out DIR
    python -m gradebook.cli mc-score --results DIR [--exclude M ...] --out DIR
    python -m gradebook.cli tokens   --judgments DIR --kind {single,pair} [--models M ...] [--prompts P] --out DIR
    python -m gradebook.cli import   --file F.jsonl --judgments DIR --mode {single,pair} --bench B [--iid TAG]

``--judgments`` is the root of a judgment log (``sources.judgment_log``), as the flows write it; ``import`` appends
JSON-lines files to one.  ``--bench``, ``--judge-model`` and ``--iid`` select by partition.  Every board is written as CSV and Markdown under ``--out``.
"""

from __future__ import annotations

import argparse
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradebook.operators import boards as B
from gradebook.operators import convert as C
from gradebook.operators import matches as M
from gradebook.operators import tokens as T
from gradebook.operators.joins import attach_labels
from gradebook.sources import judgment_log as J
from gradebook.sources import readers as R
from gradebook.sources import writers as W


def _save(board: DataFrame, out: str, name: str) -> None:
    W.write_csv(board, os.path.join(out, f"{name}.csv"))
    W.write_markdown(board, os.path.join(out, f"{name}.md"))


def _labelled(df: DataFrame, questions: DataFrame, labels: list[str]) -> DataFrame:
    return attach_labels(df, questions, labels) if labels else df.join(
        questions.select("question_id"), "question_id")


def _chosen(args) -> dict[str, str]:
    """The log partitions that a report reads."""
    return {k: v for k, v in (("bench", args.bench), ("judge_model", args.judge_model), ("iid", args.iid)) if v}


def _log(spark, args, mode: str, latest: bool) -> DataFrame:
    """The chosen part of the log; that there is nothing to report is an error."""
    rows = J.read(spark, args.judgments, mode, latest, **_chosen(args))
    if rows.isEmpty():
        raise SystemExit(f"no {mode} judgments of {_chosen(args) or 'any run'} under {args.judgments}")
    return rows


def show(spark, args) -> dict[str, DataFrame]:
    """Boards by mode, as the reporting step of a judging run."""
    q = R.read_questions(spark, args.questions)
    labels = args.label or []
    boards: dict[str, DataFrame] = {}
    if args.mode == "single":
        j = _log(spark, args, J.SINGLE, latest=True)
        j = M.filter_models(_labelled(j, q, labels), args.models)
        boards["single_summary"] = B.score_board(j)
        if labels:
            boards["single_label"] = B.score_board(j, labels=labels)
    else:
        j = _log(spark, args, J.PAIR, latest=True)
        j = M.filter_models(_labelled(j, q, labels), args.models, ("model_1", "model_2"))
        if args.mode == "pairwise-each":
            boards["pairwise_each"] = B.head_to_head(j)
            boards["pairwise_matrix"] = B.win_matrix(j)
        else:
            base = args.baseline if args.mode == "pairwise-baseline" else None
            if args.mode == "pairwise-baseline" and not base:
                raise SystemExit("--baseline is required in pairwise-baseline mode")
            boards["pairwise_summary"] = B.win_board(j, baseline=base)
            if labels:
                boards["pairwise_label"] = B.win_board(j, labels=labels, baseline=base)
    for name, board in boards.items():
        _save(board, args.out, name)
    return boards


def convert(spark, args) -> None:
    raw = R.read_raw_qa_csv(spark, args.csv, args.field_header, args.task_header)
    W.write_questions_and_refs(C.convert_raw_qa(raw), args.questions, args.references)


def mc_score(spark, args) -> DataFrame:
    res = R.read_mc_results(spark, args.results, exclude_models=args.exclude, bad_runs="drop" if args.drop_bad_runs else "raise")
    acc = B.mc_accuracy(res)
    _save(acc, args.out, "mc_accuracy")
    _save(B.mc_runs_wide(acc), args.out, "mc_runs_wide")
    return acc


def tokens(spark, args) -> DataFrame:
    from gradebook import judge_prompts as JP
    j = _log(spark, args, args.kind, latest=False)       # every call was paid for
    single, pair = (j, None) if args.kind == "single" else (None, j)
    catalog = R.read_judge_prompts(spark, args.prompts) if args.prompts else JP.as_dict()
    detail = T.token_detail(single, pair, catalog, models=args.models)
    totals = T.token_totals(detail)
    _save(totals, args.out, "token_totals")
    return totals


def import_(spark, args) -> str:
    return J.import_jsonl(spark, args.file, args.judgments, args.mode, args.commit, bench=args.bench, iid=args.iid)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="gradebook")
    sub = p.add_subparsers(dest="cmd", required=True)
    c = sub.add_parser("convert", help="raw QA CSV -> question and reference-answer JSONL")
    c.add_argument("--csv", required=True)
    c.add_argument("--questions", required=True)
    c.add_argument("--references", required=True)
    c.add_argument("--field-header", default="ops_field")
    c.add_argument("--task-header", default="task_type")
    s = sub.add_parser("show", help="score / win boards from judgment logs, by mode")
    s.add_argument("--judgments", required=True)
    s.add_argument("--questions", required=True)
    s.add_argument("--mode", default="pairwise-all",
                   choices=["single", "pairwise-all", "pairwise-baseline", "pairwise-each"])
    s.add_argument("--baseline")
    s.add_argument("--label", nargs="+")
    s.add_argument("--models", nargs="+")
    for a in ("--bench", "--judge-model", "--iid"):
        s.add_argument(a, help="only logs of this one")
    s.add_argument("--out", required=True)
    m = sub.add_parser("mc-score", help="multiple-choice accuracy per category and run")
    m.add_argument("--results", required=True)
    m.add_argument("--exclude", nargs="+")
    m.add_argument("--drop-bad-runs", action="store_true", help="leave out runs with several files or another header instead of failing")
    m.add_argument("--out", required=True)
    t = sub.add_parser("tokens", help="judge token totals per model or model pair")
    t.add_argument("--judgments", required=True)
    t.add_argument("--kind", choices=["single", "pair"], default="single")
    t.add_argument("--models", nargs="+")
    t.add_argument("--prompts", help="judge prompt catalog (JSON lines) instead of the built-in one")
    for a in ("--bench", "--judge-model", "--iid"):
        t.add_argument(a, help="only logs of this one")
    t.add_argument("--out", required=True)
    i = sub.add_parser("import", help="append a JSON-lines judgment file to a judgment log")
    i.add_argument("--file", required=True)
    i.add_argument("--judgments", required=True)
    i.add_argument("--mode", choices=[J.SINGLE, J.PAIR], required=True)
    i.add_argument("--bench", required=True)
    i.add_argument("--iid", default=J.NONE)
    i.add_argument("--commit", help="name of this append; a repeated one is not written again")
    return p


def main(argv: list[str] | None = None, spark=None):
    args = parser().parse_args(argv)
    if spark is None:
        from gradebook.session import build_session
        spark = build_session()
    return {"convert": convert, "show": show, "mc-score": mc_score, "tokens": tokens, "import": import_}[args.cmd](spark, args)


if __name__ == "__main__":
    main()
