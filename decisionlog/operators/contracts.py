"""Decision records, contract rows and chat rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decisionlog.functions.bind import let, once
from decisionlog.functions.geometry import MODES, literal_array
from decisionlog.functions.jsontext import as_text, is_text, items, member, members, strict_json
from decisionlog.functions.text import strip
from decisionlog.operators.ordered import last_items
from decisionlog.operators.toolcalls import call_violations, read_call
from decisionlog.schemas import (
    CONTRACT_KEYS,
    DECISION_KEYS,
    DEFAULT_INSTRUCTION,
    DIALOG_WINDOW,
    ENV_SKILLS,
    HISTORY_LENGTH,
    MAX_CHOICES,
    OBSERVATION,
    TRAINABLE_TOOLS,
)

_KEEP_NULLS = {"ignoreNullFields": "false"}
_INPUT_KEYS = ("objects", "gripper_hist", "memory", "user_state")
_OBJECT_KEYS = ("id", "label", "cell", "yaw", "is_held", "kind", "fill", "stacked_on", "top_of_stack")
_MEMORY_LISTS = ("candidates", "last_tool_calls", "excluded_obj_ids")


def truncate_dialogs(turns: Column, n: int = DIALOG_WINDOW) -> Column:
    """The last ``n`` turns; ``n <= 0`` keeps all."""
    return last_items(turns, n) if n > 0 else turns


def to_contract(
    df: DataFrame,
    *,
    row_number: str = "seq",
    instruction: str | None = None,
    max_past_dialogs: int = DIALOG_WINDOW,
    id_prefix: Column | str | None = None,
    own_id: str | None = None,
    meta_cols: tuple[str, ...] = (),
) -> DataFrame:
    """Typed decision records to contract rows.

    The id is ``[prefix_]episode_row``, or column ``own_id`` where it is set. ``meta_cols`` travel along in ``meta``.
    Fields a record does not have are left out of the JSON; the four input keys and empty arrays stay.
    """
    memory = F.col("memory").withField("past_dialogs", truncate_dialogs(F.col("memory.past_dialogs"), max_past_dialogs))
    blob = F.struct("objects", "gripper_hist", memory.alias("memory"), "user_state")
    return df.select(
        _contract_id(F.col("episode_id"), F.col(row_number), id_prefix, own_id).alias("id"),
        F.lit(instruction or DEFAULT_INSTRUCTION).alias("instruction"),
        F.to_json(blob).alias("input"),
        F.to_json("target_tool_call").alias("output"),
        *([F.struct(*meta_cols).alias("meta")] if meta_cols else []),
    )


def contract_from_text(
    lines: DataFrame,
    *,
    text: str = "text",
    file: str = "file",
    line: str = "line",
    instruction: str | None = None,
    max_past_dialogs: int = DIALOG_WINDOW,
    prefix_by_directory: bool = False,
    own_id: bool = False,
) -> DataFrame:
    """Raw decision-log lines to contract rows, keeping every key a record holds.

    A line that is no object, or lacks one of the six record keys, stops the job naming ``file:line``.
    """
    top = members(strict_json(F.col(text)))
    rows = lines.withColumn("_top", top)
    where = F.concat_ws(":", F.col(file), F.col(line).cast("string"))
    lacking = F.array_except(literal_array(DECISION_KEYS), F.map_keys("_top"))
    call_is_object = members(member(F.col("_top"), "target_tool_call")).isNotNull()
    checked = (
        F.when(F.col("_top").isNull(), F.raise_error(F.concat(where, F.lit(": expected one JSON object"))))
        .when(F.size(lacking) > 0, F.raise_error(F.concat(where, F.lit(": missing keys "), F.concat_ws(",", lacking))))
        .when(~call_is_object, F.raise_error(F.concat(where, F.lit(": target_tool_call must be an object"))))
        .otherwise(F.col("_top"))
    )
    rows = rows.withColumn("_top", checked)
    get = lambda name: member(F.col("_top"), name)
    prefix = directory_source(F.col(file)) if prefix_by_directory else None
    given = F.when(F.lit(own_id), F.try_variant_get(get("id"), "$", "string"))
    row_id = F.coalesce(given, _contract_id(F.try_variant_get(get("episode_id"), "$", "string"), F.col(line), prefix, None))
    memory = _windowed_memory(get("memory"), max_past_dialogs)
    parts = [F.to_json(memory) if k == "memory" else F.to_json(get(k)) for k in _INPUT_KEYS]
    body = [x for k, part in zip(_INPUT_KEYS, parts) for x in (F.lit(f'"{k}":'), part, F.lit(","))][:-1]
    return rows.select(
        row_id.alias("id"),
        F.lit(instruction or DEFAULT_INSTRUCTION).alias("instruction"),
        F.concat(F.lit("{"), *body, F.lit("}")).alias("input"),
        F.to_json(get("target_tool_call")).alias("output"),
    )


def directory_source(path: Column) -> Column:
    """Name of the directory a file lies in, without a leading ``woz_``."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]+)/[^/]*$", 1), r"^woz_", "")


def _contract_id(episode: Column, row: Column, prefix: Column | str | None, own_id: str | None) -> Column:
    lead = [] if prefix is None else [F.lit(prefix) if isinstance(prefix, str) else prefix]
    made = F.concat_ws("_", *lead, episode.cast("string"), row.cast("string"))
    return F.coalesce(F.col(own_id), made) if own_id else made


def _windowed_memory(memory: Column, n: int) -> Column:
    if n <= 0:
        return memory
    turns = items(member(members(memory), "past_dialogs"))
    kept = F.map_filter(members(memory), lambda k, v: k != "past_dialogs")
    window = F.create_map(F.lit("past_dialogs"), F.parse_json(F.to_json(last_items(turns, n))))
    rebuilt = F.parse_json(F.to_json(F.map_concat(kept, window)))
    return F.when(turns.isNotNull(), rebuilt).otherwise(memory)


def to_chat(df: DataFrame, system_prompt: str) -> DataFrame:
    """Contract rows to chat rows of three messages."""

    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    ask = F.when(
        F.coalesce(F.col("input"), F.lit("")) != "", F.concat("instruction", F.lit("\n\nInput:\n"), "input")
    ).otherwise(F.col("instruction"))
    return df.select(
        "id",
        F.array(
            message("system", F.lit(system_prompt)), message("user", ask), message("assistant", F.col("output"))
        ).alias("messages"),
    )


def unify_dialogs(turns: Column, n: int = DIALOG_WINDOW) -> Column:
    """``{prompt, reply}`` turns become an assistant and a user turn; then the last ``n``."""

    def turn(role: str | Column, content: Column) -> Column:
        return F.struct((F.lit(role) if isinstance(role, str) else role).alias("role"), content.alias("content"))

    def split(t: Column) -> Column:
        plain = t["role"].isNotNull() & t["content"].isNotNull()
        asked = F.when(t["prompt"].isNotNull(), turn("assistant", t["prompt"]))
        answered = F.when(t["reply"].isNotNull(), turn("user", t["reply"]))
        return F.when(plain, F.array(turn(t["role"], t["content"]))).otherwise(F.array(asked, answered))

    flat = F.filter(F.flatten(F.transform(turns, split)), lambda t: t.isNotNull())
    return truncate_dialogs(flat, n)


def normalize_contract(df: DataFrame) -> DataFrame:
    """Fixed-shape contract rows (P5): nine object keys, seven memory keys, mode ``translation``, arguments per tool."""
    rows = once(df, {"_in": members(strict_json(F.col("input"))), "_out": members(strict_json(F.col("output")))})
    rows = once(rows, {"_mem": members(member(F.col("_in"), "memory")), "_args": members(member(F.col("_out"), "args"))})
    none = F.array().cast("array<variant>")
    empty = F.parse_json(F.lit("{}"))

    def shaped(value: Column) -> Column:
        return let(members(value), lambda m: F.struct(*[member(m, k).alias(k) for k in _OBJECT_KEYS]))

    def logged(name: str) -> Column:
        return F.coalesce(items(member(F.col("_mem"), name)), none)

    def mapping(name: str) -> Column:
        value = member(F.col("_mem"), name)
        return F.when(members(value).isNotNull(), value).otherwise(empty)

    def word(value: Column) -> Column:
        return F.when(~(value.isNull() | (F.schema_of_variant(value) == "VOID")), as_text(value))

    def typed_turn(value: Column) -> Column:
        def typed(t: Column) -> Column:
            both = F.map_contains_key(t, F.lit("role")) & F.map_contains_key(t, F.lit("content"))
            return F.struct(
                F.when(both, as_text(member(t, "role"))).alias("role"),
                F.when(both, as_text(member(t, "content"))).alias("content"),
                word(member(t, "prompt")).alias("prompt"),
                word(member(t, "reply")).alias("reply"),
            )

        return let(members(value), typed)

    memory = F.struct(
        F.coalesce(F.try_variant_get(member(F.col("_mem"), "n_interactions"), "$", "bigint"), F.lit(0)).alias("n_interactions"),
        unify_dialogs(F.transform(logged("past_dialogs"), typed_turn)).alias("past_dialogs"),
        *[logged(k).alias(k) for k in _MEMORY_LISTS],
        *[mapping(k).alias(k) for k in ("last_action", "last_prompt")],
    )
    blob = F.struct(
        F.transform(F.coalesce(items(member(F.col("_in"), "objects")), none), shaped).alias("objects"),
        F.coalesce(items(member(F.col("_in"), "gripper_hist")), none).alias("gripper_hist"),
        memory.alias("memory"),
        F.struct(F.lit("translation").alias("mode")).alias("user_state"),
    )
    arg = lambda k: member(F.col("_args"), k).alias(k)
    tool = as_text(member(F.col("_out"), "tool"))
    choices = F.coalesce(items(member(F.col("_args"), "choices")), none).alias("choices")

    def call(*args: Column) -> Column:
        return F.to_json(F.struct(F.col("_tool").alias("tool"), F.struct(*args).alias("args")), _KEEP_NULLS)

    rows = rows.withColumn("_tool", tool)
    output = (
        F.when(F.col("_tool") == "INTERACT", call(arg("kind"), arg("text"), choices))
        .when(F.col("_tool") == "POUR", call(arg("obj"), arg("amount")))
        .otherwise(call(arg("obj")))
    )
    kept = [F.col(c) for c in df.columns if c not in CONTRACT_KEYS]
    return rows.select(
        "id", F.lit(DEFAULT_INSTRUCTION).alias("instruction"), F.to_json(blob, _KEEP_NULLS).alias("input"), output.alias("output"), *kept
    )


def env_of(row_id: Column) -> Column:
    """The environment named at the start of an id, behind an optional ``woz_`` or ``oracle_``."""
    found = F.regexp_extract(row_id, "^(?:woz_|oracle_)?(" + "|".join(ENV_SKILLS) + ")", 1)
    return F.when(found != "", found)


def with_env(df: DataFrame, id_col: str = "id", name: str = "env") -> DataFrame:
    """Add the environment; an id that names none stops the job."""
    env = env_of(F.col(id_col))
    wrong = F.raise_error(F.concat(F.lit("cannot infer the environment of id "), F.coalesce(F.col(id_col), F.lit("null"))))
    return df.withColumn(name, F.coalesce(env, wrong.cast("string")))


def filter_trainable(df: DataFrame, mode: str = "mode", tool: str = "tool") -> DataFrame:
    """Rows in translation mode whose tool is trained."""
    return df.filter((F.col(mode) == "translation") & F.col(tool).isin(*TRAINABLE_TOOLS))


def select_decision_points(df: DataFrame, *, env: str | None = None, only_interact: bool = True, env_col: str = "env") -> DataFrame:
    """Records an annotator is asked about: those of ``env`` or of none, questions only unless told otherwise."""
    rows = df if env is None else df.filter((F.coalesce(env_col, F.lit("")) == "") | (F.col(env_col) == env))
    return rows.filter(F.col("target_tool_call.tool") == "INTERACT") if only_interact else rows


def observe(df: DataFrame, text: str = "input", *, online: bool = False) -> DataFrame:
    """Add ``obs`` (typed input), ``context``, ``mode`` and ``n_cands`` read from the input JSON.

    ``online`` tells a missing last prompt (``no_last_prompt``) from one without context.
    """
    rows = df.withColumn("_top", members(strict_json(F.col(text))))
    rows = rows.withColumn("_mem", members(member(F.col("_top"), "memory")))
    prompt = members(member(F.col("_mem"), "last_prompt"))
    context = members(member(prompt, "context"))
    kind = member(context, "type")
    named = F.when(is_text(kind), strip(F.try_variant_get(kind, "$", "string")))
    no_prompt = F.when(prompt.isNull(), "no_last_prompt") if online else F.when(prompt.isNull() | (F.size(prompt) == 0), "no_context")
    bucket = F.coalesce(
        F.when(F.col("_top").isNull(), "invalid_input_json").when(F.col("_mem").isNull(), "no_memory"),
        no_prompt,
        F.when(context.isNull(), "no_context").when(F.coalesce(named, F.lit("")) == "", "unknown").otherwise(named),
    )
    state = member(F.col("_top"), "user_state")
    absent = state.isNull() | (F.schema_of_variant(state) == "VOID")
    mode_value = F.try_variant_get(member(members(state), "mode"), "$", "string")
    mode = F.when(F.col("_top").isNull() | ~(absent | members(state).isNotNull()), "unknown").otherwise(
        F.lower(F.coalesce(F.nullif(mode_value, F.lit("")), F.lit("translation")))
    )
    n_cands = F.coalesce(F.size(items(member(F.col("_mem"), "candidates"))), F.lit(0))
    obs = F.when(F.col("_top").isNotNull(), F.from_json(F.col(text), OBSERVATION))
    return rows.select(*df.columns, obs.alias("obs"), bucket.alias("context"), mode.alias("mode"), n_cands.alias("n_cands"))


def validate_contract(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split contract rows into (ok, violations) (V1): four texts present and an ``output`` of strict JSON."""
    rules = [F.when(F.col(k).isNull(), F.lit(f"missing {k}")) for k in CONTRACT_KEYS]
    rules.append(F.when(F.col("output").isNotNull() & strict_json(F.col("output")).isNull(), F.lit("output is not JSON")))
    marked = once(df, {"violations": F.filter(F.array(*rules), lambda r: r.isNotNull())})
    return marked.filter(F.size("violations") == 0).drop("violations"), marked.filter(F.size("violations") > 0)


def contract_line_violations(text: Column) -> Column:
    """The same rules on a raw JSON line, where a key may be missing or hold another type."""
    top = members(strict_json(text))
    rules = [F.when(top.isNull(), F.lit("not one JSON object"))]
    for k in CONTRACT_KEYS:
        rules.append(F.when(top.isNotNull() & ~F.map_contains_key(top, F.lit(k)), F.lit(f"missing {k}")))
        rules.append(F.when(F.map_contains_key(top, F.lit(k)) & ~is_text(member(top, k)), F.lit(f"{k} is not text")))
    output = F.try_variant_get(member(top, "output"), "$", "string")
    rules.append(F.when(is_text(member(top, "output")) & strict_json(output).isNull(), F.lit("output is not JSON")))
    return F.filter(F.array(*rules), lambda r: r.isNotNull())


def validate_decisions(df: DataFrame, env: str | Column | None = None) -> DataFrame:
    """Add ``violations`` to decision records (V3): six keys, six poses, a valid call, a known mode."""
    rows = df.withColumn("_call_text", F.to_json("target_tool_call"))
    rows = read_call(rows, "_call_text", "_call", normalise=None)
    rules = [F.when(F.col(k).isNull(), F.lit(f"missing {k}")) for k in DECISION_KEYS]
    rules.append(F.when(F.size("gripper_hist") != HISTORY_LENGTH, F.lit("gripper_hist length")))
    rules.append(F.when(~F.coalesce(F.col("user_state.mode").isin(*MODES), F.lit(False)), F.lit("user_state.mode")))
    call = F.transform(call_violations(F.col("_call"), env), lambda r: F.concat(F.lit("tool call: "), r))
    found = F.concat(F.filter(F.array(*rules), lambda r: r.isNotNull()), call)
    return rows.select(*df.columns, found.alias("violations"))


def format_checks(df: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Format report of contract rows per ``keys`` (V5): instructions, key sets, tools, questions with too many choices."""
    rows = df.withColumn("_in", members(strict_json(F.col("input")))).withColumn("_out", members(strict_json(F.col("output"))))
    tool = F.try_variant_get(member(F.col("_out"), "tool"), "$", "string")
    choices = items(member(members(member(F.col("_out"), "args")), "choices"))

    def shape(of: Column) -> Column:
        return F.concat_ws(",", F.array_sort(F.map_keys(of)))

    # The sets hold key lists and tool names: a handful of values whatever the row count.
    return rows.groupBy(*keys).agg(
        F.count_distinct("instruction").alias("instruction_count"),
        F.array_sort(F.collect_set(shape(F.col("_in")))).alias("input_keys"),
        F.array_sort(F.collect_set(shape(members(member(F.col("_in"), "memory"))))).alias("memory_keys"),
        F.array_sort(F.collect_set(tool)).alias("output_tools"),
        F.sum(((tool == "INTERACT") & (F.size(choices) > MAX_CHOICES)).cast("bigint")).alias("choice_limit_violations"),
    )
