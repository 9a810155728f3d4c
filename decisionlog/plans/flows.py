"""The end-to-end jobs, each one lazy plan up to its writes."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from decisionlog.operators import commands, contracts, evaluate, profile, questions, sampling, trials
from decisionlog.operators.ordered import by_number
from decisionlog.schemas import TRIAL_KEYS
from decisionlog.sources import trials as trial_logs
from decisionlog.sources.jsonl import read_lines


def prepare(
    spark: SparkSession, path: str | list[str], system_prompt: str, *, repeat: int = 1, keep_prob: float = 1.0, frac: float = 0.1, seed: int = 0
) -> dict[str, DataFrame]:
    """Decision logs to contract rows, a split, a rebalanced training set and chat rows.

    Returns ``contract`` (with ``source``, ``tool``, ``split``), ``train`` (rebalanced), ``chat`` (of both splits),
    ``rejected`` contract rows and ``stats`` of the rebalancing. The line numbers in ids make this plan scan the log
    once for numbering and once for the rows; store ``contract`` before writing several results.
    """
    lines = read_lines(spark, path)
    rows = contracts.contract_from_text(lines, prefix_by_directory=True)
    ok, rejected = contracts.validate_contract(rows)
    facts = profile.contract_facts(ok).select(*ok.columns, "tool")
    facts = facts.withColumn("source", F.regexp_replace("id", r"_[^_]*_[^_]*$", ""))
    split = sampling.split_by_source(facts, frac, seed)
    train = split.filter(F.col("split") == "train")
    rebalanced = sampling.rebalance(train, repeat, keep_prob, seed)
    chat = contracts.to_chat(sampling.union_sources(rebalanced, split.filter(F.col("split") == "valid")), system_prompt)
    return {
        "contract": split,
        "train": rebalanced,
        "chat": chat,
        "rejected": rejected,
        "stats": sampling.rebalance_stats(train, repeat, keep_prob, seed),
    }


def benchmark(contract: DataFrame, answers: DataFrame, keys: Sequence[str] = ()) -> dict[str, DataFrame]:
    """Contract rows joined with raw answers: report, confusion, breakdowns, error shares and wrong rows per ``keys``."""
    scored = evaluate.score(evaluate.join_predictions(contracts.observe(contract), answers)).drop("obs")
    report = evaluate.accuracy_report(scored, keys)
    return {
        "scored": scored,
        "report": report,
        "confusion": evaluate.tool_confusion(scored, keys),
        "breakdowns": evaluate.breakdowns(scored, keys=keys),
        "errors": evaluate.error_decomposition(report, keys),
    }


def baseline(contract: DataFrame, policy: Callable[[DataFrame], DataFrame], keys: Sequence[str] = ()) -> DataFrame:
    """Accuracy of a rule baseline on observed contract rows that hold the typed true call ``gt_call``."""
    return evaluate.accuracy_report(evaluate.score_typed(policy(contract)), keys)


def extract(spark: SparkSession, root: str, *, labels: DataFrame | None = None, min_support: int = 1) -> dict[str, DataFrame]:
    """Trial logs below ``root`` to valid scenarios, contract rows and a report.

    The per-trial summary of calls and the priors are checkpointed: they are small against the logs and used repeatedly.
    """
    order = by_number("seq")
    calls = trial_logs.read_calls(spark, root)
    heads = trials.trial_heads(calls, order).checkpoint()
    priors = commands.user_priors(trial_logs.read_commands(spark, root), list(TRIAL_KEYS), order).checkpoint()
    found = trials.assemble_trials(trial_logs.discover_trials(spark, root), trial_logs.read_meta(spark, root), heads)
    scenarios, dropped = trials.build_scenarios(found, heads, priors, min_support=min_support)
    skipped = None
    if labels is not None:
        scenarios, skipped = trials.overlay_labels(scenarios, labels)
    checked = trials.scenario_violations(scenarios).checkpoint()
    valid = checked.filter(F.size("violations") == 0).drop("violations")
    out = {
        "scenarios": valid,
        "contract": trials.scenarios_to_contract(valid),
        "dropped": dropped,
        "report": trials.extraction_report(checked.drop("violations"), dropped),
    }
    return out if skipped is None else {**out, "skipped": skipped}


def question_report(logged: DataFrame) -> dict[str, DataFrame]:
    """A question log to its per-question table and statistics by selector and by kind."""
    rows = questions.selector_scores(logged)
    return {
        "per_question": rows,
        "selectors": questions.ig_stats(rows, ["selector"]),
        "by_kind": questions.ig_stats(rows, ["interact_kind", "selector"]),
    }
