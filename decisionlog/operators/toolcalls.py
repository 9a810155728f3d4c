"""Tool calls held as JSON text: reading, normalising, validating, comparing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decisionlog.functions.bind import let
from decisionlog.functions.geometry import literal_array
from decisionlog.functions.jsontext import as_text, is_text, items, member, members, strict_json
from decisionlog.functions.text import strip
from decisionlog.schemas import ALL_TOOLS, ENV_SKILLS, INTERACT_KINDS, MAX_CHOICES, MOTION_TOOLS, POUR_AMOUNTS

OBJECT_ARG_TOOLS = ("APPROACH", "ALIGN_YAW", "STACK", "GRAB")


def read_call(df: DataFrame, text: str, name: str, *, normalise: str | None = "offline") -> DataFrame:
    """Add struct ``name`` describing the tool call in column ``text``.

    Fields: ``valid_json``, ``is_object``, ``tool``, ``top_keys``, ``arg_keys`` (null unless args is an object),
    ``kind``, ``text``, ``text_ok``, ``choices``, ``choices_ok``, ``obj`` (JSON text), ``obj_ok``, ``amount`` and
    ``body`` / ``body_without_text``, canonical JSON of everything but the tool.

    ``normalise`` upper-cases the tool, rebuilds INTERACT arguments (kind defaults to QUESTION, choices become text) and
    keeps only ``obj`` for the two motion tools. ``"eval"`` is the variant that rebuilds INTERACT only when the logged
    tool is already spelled ``INTERACT``, and keeps at most ten choices. ``None`` describes the call as it is.
    """
    return df.withColumn(name, describe_call(strict_json(F.col(text)), normalise=normalise))


def _text_of(value: Column) -> Column:
    """The text of a JSON string; null for any other value."""
    return F.when(is_text(value), F.try_variant_get(value, "$", "string"))


def describe_call(parsed: Column, *, normalise: str | None = "offline") -> Column:
    """The struct :func:`read_call` adds, from a VARIANT that is null for unreadable text. Every step is bound to a name."""
    if normalise not in ("offline", "eval", None):
        raise ValueError(f"unknown normaliser {normalise!r}")

    def heads(value: Column) -> Column:
        return F.struct(value.alias("value"), members(value).alias("top"))

    def tools(x: Column) -> Column:
        logged = _text_of(member(x["top"], "tool"))
        return F.struct(
            x["value"].isNotNull().alias("valid_json"),
            x["top"].alias("top"),
            members(member(x["top"], "args")).alias("args"),
            logged.alias("logged"),
            (F.upper(strip(logged)) if normalise else logged).alias("tool"),
        )

    def shapes(x: Column) -> Column:
        asks = (x["logged" if normalise == "eval" else "tool"] == "INTERACT") & x["args"].isNotNull()
        moves = x["tool"].isin(*MOTION_TOOLS) & x["args"].isNotNull()
        no = F.lit(False)
        return F.struct(
            x.alias("x"),
            (F.coalesce(asks, no) if normalise else no).alias("asked"),
            (F.coalesce(moves, no) if normalise else no).alias("moved"),
        )

    def values(s: Column) -> Column:
        args = s["x"]["args"]
        kind = F.when(s["asked"] & ~F.map_contains_key(args, F.lit("kind")), member(args, "type")).otherwise(member(args, "kind"))
        named = F.upper(strip(_text_of(kind)))
        words = member(args, "text")
        nothing = words.isNull() | (F.schema_of_variant(words) == "VOID")
        listed = F.transform(items(member(args, "choices")), as_text)
        if normalise == "eval":
            listed = F.when(s["asked"], F.slice(listed, 1, 10)).otherwise(listed)
        return F.struct(
            s.alias("s"),
            F.when(s["asked"], F.when(named.isin(*INTERACT_KINDS), named).otherwise("QUESTION")).otherwise(_text_of(kind)).alias("kind"),
            F.when(s["asked"] & nothing, F.lit("")).when(s["asked"] | is_text(words), as_text(words)).alias("text"),
            (s["asked"] | is_text(words)).alias("text_ok"),
            F.when(s["asked"], F.coalesce(listed, F.array().cast("array<string>"))).otherwise(listed).alias("choices"),
            F.to_json(member(args, "obj")).alias("obj"),
        )

    def described(v: Column) -> Column:
        s, x = v["s"], v["s"]["x"]
        top, args, asked, moved = x["top"], x["args"], s["asked"], s["moved"]
        question = [v["choices"].alias("choices"), v["kind"].alias("kind")]
        rest = F.when(moved, F.coalesce(v["obj"], F.lit("null"))).otherwise(F.to_json(F.map_filter(top, lambda k, _: k != "tool")))
        own_args = F.when(moved, literal_array(("obj",))).otherwise(F.array_sort(F.map_keys(args)))
        all_text = F.coalesce(F.forall(items(member(args, "choices")), is_text), F.lit(False))
        return F.struct(
            x["valid_json"].alias("valid_json"),
            top.isNotNull().alias("is_object"),
            F.coalesce(x["tool"], F.lit("None")).alias("tool"),
            F.when(asked | moved, literal_array(("args", "tool"))).otherwise(F.array_sort(F.map_keys(top))).alias("top_keys"),
            F.when(asked, literal_array(("choices", "kind", "text"))).otherwise(own_args).alias("arg_keys"),
            v["kind"].alias("kind"),
            v["text"].alias("text"),
            v["text_ok"].alias("text_ok"),
            v["choices"].alias("choices"),
            (asked | all_text).alias("choices_ok"),
            v["obj"].alias("obj"),
            is_text(member(args, "obj")).alias("obj_ok"),
            _text_of(member(args, "amount")).alias("amount"),
            F.when(asked, F.to_json(F.struct(*question, v["text"].alias("text")))).otherwise(rest).alias("body"),
            F.when(asked, F.to_json(F.struct(*question))).otherwise(rest).alias("body_without_text"),
        )

    bound = let(let(let(let(parsed, heads), tools), shapes), values)
    return let(bound, described)


def describe_typed(call: Column, fields: Sequence[str]) -> Column:
    """The struct of :func:`describe_call` (``offline``) for a typed call ``<tool, args<...>>``, without any JSON.

    ``fields`` names the members of ``args``; those that are null count as absent.
    """

    def described(c: Column) -> Column:
        read = F.struct(F.upper(strip(c["tool"])).alias("tool"), F.upper(strip(text(c["args"], "kind"))).alias("named"))
        return let(let(read, lambda r: shapes(c, r)), lambda s: body(c, s))

    def text(args: Column, f: str) -> Column:
        return args[f].cast("string") if f in fields else F.lit(None).cast("string")

    def shapes(c: Column, r: Column) -> Column:
        args, tool, named = c["args"], r["tool"], r["named"]
        choices = args["choices"] if "choices" in fields else F.lit(None).cast("array<string>")
        asked = F.coalesce((tool == "INTERACT") & args.isNotNull(), F.lit(False))
        return F.struct(
            tool.alias("tool"),
            choices.alias("choices"),
            asked.alias("asked"),
            F.coalesce(tool.isin(*MOTION_TOOLS) & args.isNotNull(), F.lit(False)).alias("moved"),
            F.when(asked, F.when(named.isin(*INTERACT_KINDS), named).otherwise("QUESTION")).otherwise(text(args, "kind")).alias("kind"),
            F.when(asked, F.coalesce(choices, F.array().cast("array<string>"))).otherwise(choices).alias("listed"),
            F.when(asked, F.coalesce(text(args, "text"), F.lit(""))).otherwise(text(args, "text")).alias("words"),
        )

    def body(c: Column, s: Column) -> Column:
        args = c["args"]
        tool, choices, asked, moved, kind, listed, words = (s[f] for f in ("tool", "choices", "asked", "moved", "kind", "listed", "words"))
        present = F.array(*[F.when(args[f].isNotNull(), F.lit(f)) for f in sorted(fields)])
        own = F.when(asked, literal_array(("choices", "kind", "text"))).when(moved, literal_array(("obj",))).otherwise(F.filter(present, lambda x: x.isNotNull()))
        sep, gone = F.lit("\u0001"), F.lit("\u0002")
        question = F.concat(kind, sep, F.array_join(listed, "\u0003"))
        rest = F.when(moved, F.coalesce(text(args, "obj"), gone)).otherwise(F.concat(*[F.concat(F.coalesce(text(args, f), gone), sep) for f in ("kind", "text", "obj", "amount")], F.coalesce(F.array_join(listed, "\u0003"), gone)))
        return F.struct(
            c.isNotNull().alias("valid_json"),
            c.isNotNull().alias("is_object"),
            F.coalesce(tool, F.lit("None")).alias("tool"),
            literal_array(("args", "tool")).alias("top_keys"),
            F.when(args.isNotNull(), own).alias("arg_keys"),
            kind.alias("kind"),
            words.alias("text"),
            (asked | text(args, "text").isNotNull()).alias("text_ok"),
            listed.alias("choices"),
            (asked | choices.isNotNull()).alias("choices_ok"),
            text(args, "obj").alias("obj"),
            text(args, "obj").isNotNull().alias("obj_ok"),
            text(args, "amount").alias("amount"),
            F.when(asked, F.concat(question, sep, words)).otherwise(rest).alias("body"),
            F.when(asked, question).otherwise(rest).alias("body_without_text"),
        )

    return let(call, described)


def call_violations(call: Column, env: Column | str | None = None) -> Column:
    """Every rule a described call breaks, as an array of names (empty when valid).

    With ``env`` the tool must also belong to that environment's skills.
    """
    place = F.lit(None).cast("string") if env is None else F.lit(env) if isinstance(env, str) else env
    return let(F.struct(call.alias("call"), place.alias("env")), lambda x: _broken_rules(x["call"], None if env is None else x["env"]))


def _broken_rules(call: Column, env: Column | None) -> Column:
    tool, args = call["tool"], call["arg_keys"]
    if env is None:
        known, known_env = tool.isin(*ALL_TOOLS), F.lit(True)
    else:
        pairs = [x for e, skills in ENV_SKILLS.items() for x in (F.lit(e), literal_array(skills))]
        skills = F.try_element_at(F.create_map(*pairs), env)
        known_env = skills.isNotNull()
        known = F.coalesce(F.array_contains(skills, tool), F.lit(False))
    asks, has_args = tool == "INTERACT", args.isNotNull()

    def keys_are(*names: str) -> Column:
        return args == literal_array(names)

    # digits up to the first bracket, or all through
    numbered = F.forall(call["choices"], lambda c: F.coalesce(c.rlike(r"^\p{Nd}+(?:\)|\z)"), F.lit(False)))
    n_choices = F.coalesce(F.size(call["choices"]), F.lit(0))
    has_choices = call["choices"].isNotNull() & call["choices_ok"] & (n_choices > 0)
    asked, moved, poured = asks & has_args, tool.isin(*OBJECT_ARG_TOOLS) & has_args, (tool == "POUR") & has_args
    checks = [
        (~call["is_object"], "not_an_object"),
        (call["is_object"] & (call["top_keys"] != literal_array(("args", "tool"))), "keys"),
        (~known_env, "unknown_env"),
        (known_env & ~known, "tool"),
        (~has_args, "args"),
        (asked & ~keys_are("choices", "kind", "text"), "interact_keys"),
        (asked & ~F.coalesce(call["kind"].isin(*INTERACT_KINDS), F.lit(False)), "interact_kind"),
        (asked & ~call["text_ok"], "interact_text"),
        (asked & ~has_choices, "interact_choices"),
        (asked & (n_choices > MAX_CHOICES), "interact_too_many_choices"),
        (asked & has_choices & ~numbered, "interact_choice_prefix"),
        (moved & ~(keys_are("obj") & call["obj_ok"]), "obj_args"),
        ((tool == "RELEASE") & has_args & (F.size(args) > 0), "release_args"),
        (poured & ~keys_are("amount", "obj"), "pour_keys"),
        (poured & ~call["obj_ok"], "pour_obj"),
        (poured & ~F.coalesce(call["amount"].isin(*POUR_AMOUNTS), F.lit(False)), "pour_amount"),
    ]
    broken = F.array(*[F.when(F.coalesce(test, F.lit(True)), F.lit(rule)) for test, rule in checks])
    return F.filter(broken, lambda rule: rule.isNotNull())


def same_call(a: Column, b: Column, *, ignore_text: bool = True) -> Column:
    """Equal calls; two questions may be compared without their wording."""
    exact = F.coalesce((a["tool"] == b["tool"]) & (a["body"] == b["body"]), F.lit(False))
    if not ignore_text:
        return exact
    loose = (a["tool"] == "INTERACT") & (b["tool"] == "INTERACT") & (a["body_without_text"] == b["body_without_text"])
    return exact | F.coalesce(loose, F.lit(False))
