"""What a question is worth: intent, simulated replies, information gain, selectors.

Scenes hold about ten objects and questions at most a few choices, so scoring stays inside the row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from decisionlog.functions.draw import draw, pick
from decisionlog.functions.text import is_no, is_none_of_them, is_yes, plain_choice, strip
from decisionlog.operators.ordered import Order, position
from decisionlog.operators.policies import motion_shares
from decisionlog.schemas import INTERACT_KINDS

_TEXTS = "array<string>"
_PICKS = "array<struct<idx:int,obj:string>>"
SELECTORS = ("chosen", "no_rerank", "random", "info_gain")


def _filled(column: Column | str, kind: str = _TEXTS) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.array().cast(kind))


def live_candidates(df: DataFrame, obs: str = "obs", name: str = "live") -> DataFrame:
    """Add the candidates not excluded so far, duplicates and order kept."""
    gone = _filled(f"{obs}.memory.excluded_obj_ids")
    return df.withColumn(name, F.filter(_filled(f"{obs}.memory.candidates"), lambda c: ~F.array_contains(gone, c)))


def entropy_bits(n: Column) -> Column:
    """Entropy in bits of ``n`` equally likely items."""
    return F.when(n > 1, F.log2(n.cast("double"))).otherwise(F.lit(0.0))


def weighted_entropy_bits(items: Column, weights: Column) -> Column:
    """Entropy of ``items`` under a ``map<string,double>`` of weights, normalised over the items.

    Uniform when no item has weight; 0 for fewer than two items.
    """
    n = F.size(items)
    ws = F.transform(items, lambda i: F.greatest(F.coalesce(F.try_element_at(weights, i), F.lit(0.0)), F.lit(0.0)))
    z = F.aggregate(ws, F.lit(0.0), lambda a, w: a + w)
    h = F.aggregate(ws, F.lit(0.0), lambda a, w: a - F.when(w > 0, w / z * F.log2(w / z)).otherwise(0.0))
    return F.when(n <= 1, F.lit(0.0)).when(z <= 0, F.log2(n.cast("double"))).otherwise(h)


def classify_questions(df: DataFrame, question: str = "question", obs: str = "obs", live: str = "live") -> DataFrame:
    """Add struct ``intent`` <kind, targets, yes_idx, no_idx, picks, none_idx>.

    ``candidate_choice``: at least two choices each name exactly one live candidate. ``binary_confirm``: a yes and a no
    choice and exactly one live candidate named in the text. Anything else, and a null question, is ``noop``.
    """
    low = lambda c: F.lower(strip(F.coalesce(c, F.lit(""))))
    named = F.filter(
        F.transform(
            F.filter(F.coalesce(f"{obs}.objects", F.array().cast(df.select(f"{obs}.objects").schema[0].dataType)), lambda o: F.array_contains(live, o["id"])),
            lambda o: F.struct(o["id"].alias("id"), low(o["label"]).alias("label")),
        ),
        lambda o: o["label"] != "",
    )
    rows = df.withColumns({"_named": named, "_plain": F.transform(_filled(f"{question}.choices"), plain_choice)})

    def resolve(plain: Column, i: Column) -> Column:
        text = F.lower(plain)
        hits = F.filter("_named", lambda o: F.contains(text, o["label"]) | F.contains(o["label"], text))
        clear = (text != "") & ~is_none_of_them(plain) & (F.size(hits) == 1)
        return F.when(clear, F.struct(i.alias("idx"), F.get(hits, F.lit(0))["id"].alias("obj")))

    def first_index(test) -> Column:
        found = F.filter(F.transform("_plain", lambda p, i: F.when(test(p), i)), lambda i: i.isNotNull())
        return F.get(found, F.lit(0))

    none_of = F.filter(F.transform("_plain", lambda p, i: F.when(is_none_of_them(p), i)), lambda i: i.isNotNull())
    wording = F.lower(F.coalesce(f"{question}.text", F.lit("")))
    rows = rows.withColumns(
        {
            "_picks": F.filter(F.transform("_plain", resolve), lambda p: p.isNotNull()),
            "_none": F.get(none_of, F.size(none_of) - 1),
            "_yes": first_index(is_yes),
            "_no": first_index(is_no),
            "_told": F.filter("_named", lambda o: F.contains(wording, o["label"])),
        }
    )
    menu = F.size("_picks") >= 2
    confirm = F.col("_yes").isNotNull() & F.col("_no").isNotNull() & (F.size("_told") == 1)

    def intent(kind: str, targets: Column, yes=None, no=None, picks=None, none=None) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"),
            targets.cast(_TEXTS).alias("targets"),
            F.lit(None).cast("int").alias("yes_idx") if yes is None else yes.cast("int").alias("yes_idx"),
            F.lit(None).cast("int").alias("no_idx") if no is None else no.cast("int").alias("no_idx"),
            (F.array() if picks is None else picks).cast(_PICKS).alias("picks"),
            F.lit(None).cast("int").alias("none_idx") if none is None else none.cast("int").alias("none_idx"),
        )

    listed = F.array_sort(F.array_distinct(F.transform("_picks", lambda p: p["obj"])))
    found = (
        F.when(menu, intent("candidate_choice", listed, picks=F.col("_picks"), none=F.col("_none")))
        .when(confirm, intent("binary_confirm", F.transform("_told", lambda o: o["id"]), F.col("_yes"), F.col("_no")))
        .otherwise(intent("noop", F.array()))
    )
    return rows.select(*df.columns, found.alias("intent"))


def _pick_at(intent: Column, i: Column) -> Column:
    return F.get(F.filter(intent["picks"], lambda p: p["idx"] == i), F.lit(0))["obj"]


def _after(intent: Column, live: Column, i: Column) -> Column:
    """Candidates left after reply ``i``."""
    target = F.get(intent["targets"], F.lit(0))
    picked = _pick_at(intent, i)
    only = lambda c: F.when(F.array_contains(live, c), F.array(c)).otherwise(live)
    confirm = (
        F.when(i == intent["yes_idx"], only(target))
        .when(i == intent["no_idx"], F.filter(live, lambda c: c != target))
        .otherwise(live)
    )
    choice = (
        F.when(i == intent["none_idx"], F.filter(live, lambda c: ~F.array_contains(intent["targets"], c)))
        .when(picked.isNotNull(), only(picked))
        .otherwise(live)
    )
    return F.when(intent["kind"] == "binary_confirm", confirm).when(intent["kind"] == "candidate_choice", choice).otherwise(live)


def _indices(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def simulate_replies(df: DataFrame, question: str = "question", obs: str = "obs", live: str = "live") -> DataFrame:
    """Add ``replies``: per reply index the candidates left and the ids excluded (B6). Needs ``intent``."""
    intent = F.col("intent")
    gone = _filled(f"{obs}.memory.excluded_obj_ids")

    def reply(i: Column) -> Column:
        refused = (intent["kind"] == "binary_confirm") & (i == intent["no_idx"]) & ~F.array_contains(gone, F.get(intent["targets"], F.lit(0)))
        rejected = (intent["kind"] == "candidate_choice") & (i == intent["none_idx"])
        more = F.array_sort(F.array_union(gone, intent["targets"]))
        return F.struct(
            i.alias("idx"),
            _after(intent, F.col(live), i).alias("candidates"),
            F.when(refused | rejected, more).otherwise(gone).alias("excluded"),
        )

    n = F.size(_filled(f"{question}.choices"))
    return df.withColumn("replies", F.transform(_indices(n), reply))


def information_gain(
    df: DataFrame, prior: str = "uniform", question: str = "question", obs: str = "obs", live: str = "live"
) -> DataFrame:
    """Add ``h_before_bits``, ``h_after_expected_bits``, ``ig_bits`` and ``per_reply`` [{idx, p, h}].

    Needs ``intent``. ``prior`` weighs the replies: all alike, or by how the last motion favours the named objects.
    """
    if prior not in ("uniform", "motion_weighted"):
        raise ValueError(f"unknown reply prior {prior!r}")
    intent, n = F.col("intent"), F.size(_filled(f"{question}.choices"))
    rows = df.withColumn("_n", n)
    even = lambda i: F.lit(1.0) / F.col("_n")
    chance = even
    if prior == "motion_weighted":
        shares = motion_shares(F.col(live), F.col(f"{obs}.objects"), F.col(f"{obs}.gripper_hist"))
        rows = rows.withColumn("_shares", shares)

        def mass(obj: Column) -> Column:
            return F.coalesce(F.get(F.filter("_shares", lambda s: s["id"] == obj), F.lit(0))["p"], F.lit(0.0))

        listed = F.aggregate(intent["picks"], F.lit(0.0), lambda a, p: a + mass(p["obj"]))
        rows = rows.withColumn("_listed", listed).withColumn("_yes_p", F.least(mass(F.get(intent["targets"], F.lit(0))), F.lit(1.0)))

        def weight(i: Column) -> Column:
            confirm = F.when(i == intent["no_idx"], 1.0 - F.col("_yes_p")).when(i == intent["yes_idx"], F.col("_yes_p")).otherwise(0.0)
            picked = _pick_at(intent, i)
            choice = (
                F.when(i == intent["none_idx"], F.greatest(1.0 - F.col("_listed"), F.lit(0.0)))
                .when(picked.isNotNull(), mass(picked))
                .otherwise(0.0)
            )
            return F.when(intent["kind"] == "binary_confirm", confirm).otherwise(choice)

        rows = rows.withColumn("_weights", F.transform(_indices(F.col("_n")), weight))
        rows = rows.withColumn("_z", F.aggregate("_weights", F.lit(0.0), lambda a, w: a + w))

        def chance(i: Column) -> Column:
            weighted = F.get("_weights", i) / F.when(F.col("_z") > 0, F.col("_z")).otherwise(1.0)
            return F.when(intent["kind"] == "noop", even(i)).otherwise(weighted)

    def reply(i: Column) -> Column:
        left = F.size(_after(intent, F.col(live), i))
        return F.struct(i.alias("idx"), chance(i).alias("p"), entropy_bits(left).alias("h"))

    rows = rows.withColumn("per_reply", F.transform(_indices(F.col("_n")), reply))
    before = entropy_bits(F.size(live))
    expected = F.when(F.col("_n") > 0, F.aggregate("per_reply", F.lit(0.0), lambda a, r: a + r["p"] * r["h"])).otherwise(before)
    rows = rows.withColumns({"h_before_bits": before, "h_after_expected_bits": expected})
    gain = F.greatest(F.col("h_before_bits") - F.col("h_after_expected_bits"), F.lit(0.0))
    return rows.withColumn("ig_bits", gain).select(*df.columns, "h_before_bits", "h_after_expected_bits", "ig_bits", "per_reply")


def reply_profile(df: DataFrame, question: str = "question", live: str = "live") -> DataFrame:
    """Add struct ``profile`` <live, choices, settled, left>: all that a question's gain under alike replies depends on. Needs ``intent``.

    ``settled`` replies leave one candidate, at most one reply leaves ``left`` of them (null: none does), every other leaves all ``live``.
    """
    intent, kept = F.col("intent"), F.col(live)
    n = F.size(_filled(f"{question}.choices"))
    target = F.get(intent["targets"], F.lit(0))
    confirm, choice = intent["kind"] == "binary_confirm", intent["kind"] == "candidate_choice"
    inside = lambda i: i.isNotNull() & (i >= 0) & (i < n)
    agreed = inside(intent["yes_idx"]) & F.array_contains(kept, target)
    named = F.size(F.filter(intent["picks"], lambda p: F.array_contains(kept, p["obj"])))
    refused = inside(intent["no_idx"]) & ~F.coalesce(intent["no_idx"] == intent["yes_idx"], F.lit(False))
    without = F.when(refused, F.size(F.filter(kept, lambda c: c != target)))
    rest = F.when(inside(intent["none_idx"]), F.size(F.filter(kept, lambda c: ~F.array_contains(intent["targets"], c))))
    found = F.struct(
        F.size(kept).alias("live"),
        n.alias("choices"),
        F.when(confirm, F.coalesce(agreed, F.lit(False)).cast("int")).when(choice, named).otherwise(0).alias("settled"),
        F.when(confirm, without).when(choice, rest).alias("left"),
    )
    return df.withColumn("profile", found)


def profile_gain(df: DataFrame, profile: str = "profile") -> DataFrame:
    """``h_before_bits``, ``h_after_expected_bits`` and ``ig_bits`` in closed form from a question's profile (B7, alike replies)."""
    p = F.col(profile)
    before, has_left = entropy_bits(p["live"]), p["left"].isNotNull().cast("int")
    whole = p["choices"] - p["settled"] - has_left
    after = (whole * before + F.when(p["left"].isNotNull(), entropy_bits(p["left"])).otherwise(0.0)) / p["choices"]
    rows = df.withColumns({"h_before_bits": before, "h_after_expected_bits": F.when(p["choices"] > 0, after).otherwise(before)})
    return rows.withColumn("ig_bits", F.greatest(F.col("h_before_bits") - F.col("h_after_expected_bits"), F.lit(0.0)))


def question_kind(kind: Column) -> Column:
    """One of the three question kinds, else ``OTHER``."""
    named = F.upper(F.coalesce(kind, F.lit("")))
    return F.when(named.isin(*INTERACT_KINDS), named).otherwise("OTHER")


def score_contract_ig(contract: DataFrame, prior: str = "uniform") -> DataFrame:
    """Score every ground-truth question of an observed contract.

    ``contract`` holds ``obs`` and the typed true call ``gt_call``; bits are rounded to six digits.
    """
    asked = contract.filter(F.col("gt_call.tool") == "INTERACT").withColumn("question", F.col("gt_call.args"))
    rows = classify_questions(live_candidates(asked))
    scored = profile_gain(reply_profile(rows)) if prior == "uniform" else information_gain(rows, prior)
    return scored.select(
        *contract.columns,
        question_kind(F.col("question.kind")).alias("interact_kind"),
        F.col("intent.kind").alias("context_type_hint"),
        F.size("live").alias("n_candidates_before"),
        *[F.round(c, 6).alias(c) for c in ("h_before_bits", "h_after_expected_bits", "ig_bits")],
    )


def selector_scores(questions: DataFrame) -> DataFrame:
    """Logged questions to one row per selector (B9): ``chosen``, ``no_rerank``, ``random``, ``info_gain``.

    The first scores the chosen question, the others the first candidate, the candidates' mean and their best.
    Questions without candidates are left out.
    """
    igs = F.transform("candidates", lambda c: F.coalesce(c["ig_bits"], F.lit(0.0)))
    mean = F.aggregate("_igs", F.lit(0.0), lambda a, x: a + x) / F.size("_igs")
    rows = questions.filter(F.size("candidates") > 0).withColumn("_igs", igs)
    values = (F.coalesce("ig_bits", F.lit(0.0)), F.get("_igs", F.lit(0)), mean, F.array_max("_igs"))
    entries = F.array(
        *[F.struct(F.lit(s).alias("selector"), F.round(v, 6).alias("ig_bits")) for s, v in zip(SELECTORS, values)]
    )
    kept = [c for c in questions.columns if c not in ("candidates", "chosen", "ig_bits", "selector", "interact_kind")]
    return rows.select(*kept, question_kind(F.col("interact_kind")).alias("interact_kind"), F.explode(entries).alias("_e")).select(
        *kept, "interact_kind", "_e.selector", "_e.ig_bits"
    )


def select_question(questions: DataFrame, selector: str, seed: int = 0, *, reference: str | None = None, id_cols: Sequence[str] = ("scenario_id", "seed", "condition", "tick")) -> DataFrame:
    """Add ``picked``, the index of the candidate a selector takes.

    ``info_gain``: most bits, then fewer choices, then first. ``random``: a seeded draw. ``none`` / ``passthrough``: the
    first. ``oracle``: the first identical to the ``reference`` call, else the one sharing most choices with it.
    """
    name = (selector or "").strip().lower()
    n_choices = lambda c: F.coalesce(F.size(c["tool_call"]["args"]["choices"]), F.lit(0))
    if name == "info_gain":
        ranked = F.transform(
            "candidates",
            lambda c, i: F.struct(F.coalesce(c["ig_bits"], F.lit(0.0)).alias("v"), (-n_choices(c)).alias("n"), (-i).alias("o")),
        )
        best = -F.array_max(ranked)["o"]
    elif name == "random":
        token = draw(F.concat_ws("#", *[F.col(c).cast("string") for c in id_cols]), "selector", seed)
        best = pick(token, F.greatest(F.size("candidates"), F.lit(1)))
    elif name in ("none", "passthrough"):
        best = F.lit(0)
    elif name == "oracle":
        if reference is None:
            raise ValueError("the oracle selector needs a reference call column")
        own = F.col(f"{reference}.args.choices")
        ranked = F.transform(
            "candidates",
            lambda c, i: F.struct(
                c["tool_call"].eqNullSafe(F.col(reference)).cast("int").alias("same"),
                F.coalesce(F.size(F.array_intersect(c["tool_call"]["args"]["choices"], own)), F.lit(0)).alias("shared"),
                (-i).alias("o"),
            ),
        )
        best = F.when(F.col(reference).isNull(), F.lit(0)).otherwise(-F.array_max(ranked)["o"])
    else:
        raise ValueError(f"unknown selector {selector!r}")
    return questions.withColumn("picked", F.coalesce(best, F.lit(0)).cast("int"))


def distinct_questions(candidates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One candidate per (kind, sorted choices) and ``keys``, the one sampled first (U4).

    ``candidates`` is long: ``keys, sample_idx, question`` <kind, text, choices>.
    """
    rows = candidates.withColumns({"_kind": F.upper(F.coalesce("question.kind", F.lit(""))), "_choices": F.array_sort(_filled("question.choices"))})
    kept = [c for c in candidates.columns if c not in keys]
    first = F.min_by(F.struct(*kept), F.col("sample_idx")).alias("_q")
    return rows.groupBy(*keys, "_kind", "_choices").agg(first).select(*keys, "_q.*")


def state_hash(obs: str = "obs") -> Column:
    """The digest that names a state: objects with cell and yaw, current pose, candidates and excluded ids."""
    known = lambda c: F.coalesce(c, F.lit(""))
    objects = F.array_sort(
        F.transform(f"{obs}.objects", lambda o: F.array(known(o["id"]), known(o["cell"]), known(o["yaw"])))
    )
    now = F.get(f"{obs}.gripper_hist", F.size(f"{obs}.gripper_hist") - 1)
    state = F.struct(
        F.array_sort(_filled(f"{obs}.memory.candidates")).alias("cands"),
        F.array_sort(_filled(f"{obs}.memory.excluded_obj_ids")).alias("excl"),
        F.array(now["cell"], now["yaw"]).alias("gripper"),
        F.coalesce(objects, F.array().cast("array<array<string>>")).alias("objs"),
    )
    return F.sha2(F.to_json(state, {"ignoreNullFields": "false"}), 256)


def dedup_states(df: DataFrame, order: Order, obs: str = "obs", columns: Sequence[str] | None = None) -> DataFrame:
    """The first row of each distinct state, with its ``state_hash``.

    ``columns``: what is wanted of that row; whole rows, with their scenes, go through the shuffle and the sort otherwise.
    """
    rows = df.withColumn("state_hash", state_hash(obs))
    return rows.groupBy("state_hash").agg(F.min_by(F.struct(*(columns or df.columns)), order.key).alias("_row")).select("_row.*", "state_hash")


def question_log(scored: DataFrame, keys: Sequence[str], order: Order, selector: str = "info_gain", seed: int = 0) -> DataFrame:
    """Question-log rows from scored candidates.

    ``scored`` has one row per decision: ``keys``, ``obs``, ``live`` and ``candidates`` [{sample_idx, tool_call, ig_bits,
    h_after, per_reply}]. The tick counts decisions per ``keys``; bits are rounded to six digits.
    """
    rows = position(scored, keys, order, "tick").withColumn("tick", F.col("tick") - 1)
    rows = select_question(rows, selector, seed, id_cols=(*keys, "tick"))
    taken = F.get("candidates", F.col("picked"))
    logged = F.transform(
        "candidates",
        lambda c: F.struct(
            c["sample_idx"].alias("sample_idx"),
            c["tool_call"].alias("tool_call"),
            F.round(c["ig_bits"], 6).alias("ig_bits"),
            F.transform(
                c["per_reply"],
                lambda r: F.array(r["idx"].cast("double"), F.round(r["p"], 6), F.round(r["h"], 6)),
            ).alias("per_reply"),
        ),
    )
    return rows.select(
        *keys,
        "tick",
        state_hash().alias("state_hash"),
        F.lit(selector).alias("selector"),
        F.size("candidates").alias("k_candidates"),
        F.size("live").alias("n_candidates_before"),
        F.round(entropy_bits(F.size("live")), 6).alias("h_before_bits"),
        F.round(taken["h_after"], 6).alias("h_after_expected_bits"),
        F.round(taken["ig_bits"], 6).alias("ig_bits"),
        F.upper(F.coalesce(taken["tool_call"]["args"]["kind"], F.lit(""))).alias("interact_kind"),
        taken["tool_call"].alias("chosen"),
        logged.alias("candidates"),
    )


def ig_stats(q: DataFrame, keys: Sequence[str] = (), gate: float = 0.5, value: str = "ig_bits") -> DataFrame:
    """``n``, mean, exact median and the share of questions with at least ``gate`` bits, per ``keys``.

    Equal values (to six digits) are counted before the median is taken, so a group of any size is held as its distinct
    values only.
    """
    counts = q.groupBy(*keys, F.round(value, 6).alias("_v")).agg(F.count("*").alias("_c"))
    n = F.sum("_c")
    return counts.groupBy(*keys).agg(
        n.alias("n"),
        F.round(F.sum(F.col("_v") * F.col("_c")) / n, 4).alias("mean"),
        F.round(F.percentile("_v", 0.5, F.col("_c")), 4).alias("median"),
        F.round(F.sum(F.when(F.col("_v") >= gate, F.col("_c")).otherwise(0)) / n, 4).alias("frac_ge_gate"),
    )


def ig_histogram(
    q: DataFrame,
    keys: Sequence[str] = ("interact_kind",),
    width: float = 0.05,
    hi: float = 2.0,
    *,
    multi_candidate_only: bool = False,
    density: bool = False,
    value: str = "ig_bits",
) -> DataFrame:
    """Counts per bin of ``width`` bits between 0 and ``hi``; the last bin is closed.

    Values are clipped to the range. With ``density`` values outside are left out and ``density`` is added: share per
    bit, integrating to 1 over the bins of each key (A27b).
    """
    rows = q.filter(F.col("n_candidates_before") > 1) if multi_candidate_only else q
    if density:
        rows = rows.filter(F.col(value).between(0.0, hi))
    bins = round(hi / width)
    clipped = F.least(F.greatest(F.col(value), F.lit(0.0)), F.lit(hi))
    # rounding keeps a value that equals an edge up to float noise in the bin it opens
    index = F.least(F.floor(F.round(clipped / width, 9)), F.lit(bins - 1)).cast("int")
    counts = rows.groupBy(*keys, index.alias("bin")).agg(F.count("*").alias("n"))
    counts = counts.withColumn("bin_start", F.round(F.col("bin") * width, 6))
    if density:
        whole = F.sum("n").over(Window.partitionBy(*keys))  # at most ``bins`` rows per key
        counts = counts.withColumn("density", F.col("n") / whole / width)
    return counts


def ig_overview(q: DataFrame, gate: float = 0.5, keys: Sequence[str] = (), value: str = "ig_bits") -> DataFrame:
    """:func:`ig_stats` plus the share of questions worth anything."""
    counts = q.groupBy(*keys, F.round(value, 6).alias("_v")).agg(F.count("*").alias("_c"))
    n = F.sum("_c")
    share = lambda t: F.sum(F.when(t, F.col("_c")).otherwise(0)) / n
    return counts.groupBy(*keys).agg(
        n.alias("n"),
        (F.sum(F.col("_v") * F.col("_c")) / n).alias("mean_ig_bits"),
        F.percentile("_v", 0.5, F.col("_c")).alias("median_ig_bits"),
        share(F.col("_v") >= gate).alias("frac_ge_gate"),
        share(F.col("_v") > 0).alias("frac_gt_0"),
    )
