"""Table schemas (DDL) and the fixed vocabularies they use."""

from __future__ import annotations

# Tools each environment offers, and the radius within which an object is a candidate there.
ENV_SKILLS = {
    "reach_to_grasp_ycb": ("INTERACT", "APPROACH", "ALIGN_YAW"),
    "cube_stacking": ("INTERACT", "APPROACH", "ALIGN_YAW", "STACK", "RELEASE"),
    "pouring": ("INTERACT", "APPROACH", "ALIGN_YAW", "GRAB", "POUR"),
}
ENV_RADIUS = {"reach_to_grasp_ycb": 1, "cube_stacking": 2, "pouring": 2}
# Tool groups, question kinds, pour amounts, the choice limit.
ALL_TOOLS = ("INTERACT", "APPROACH", "ALIGN_YAW", "STACK", "RELEASE", "GRAB", "POUR")
ACTION_TOOLS = ("APPROACH", "ALIGN_YAW", "STACK", "GRAB", "POUR", "RELEASE")
MOTION_TOOLS = ("APPROACH", "ALIGN_YAW")
TRAINABLE_TOOLS = ("INTERACT", "APPROACH", "ALIGN_YAW", "STACK", "GRAB", "POUR")
INTERACT_KINDS = ("QUESTION", "SUGGESTION", "CONFIRM")
POUR_AMOUNTS = ("SMALL", "HALF", "FULL")
MAX_CHOICES = 5
HISTORY_LENGTH = 6
DIALOG_WINDOW = 12
# The label vocabulary.
OBJECT_LABELS = (
    "bleach_cleanser",
    "gelatin_box",
    "master_chef_can",
    "mug",
    "mustard_bottle",
    "potted_meat_can",
    "pudding_box",
    "sugar_box",
    "tomato_soup_can",
    "tuna_fish_can",
)
# Fixed value: the instruction every contract row carries by default.
DEFAULT_INSTRUCTION = (
    "Given the robot observation and dialog context, infer the user's intent and "
    "emit exactly one tool call. Output ONLY the tool call JSON with keys tool and args. "
    "If the tool is INTERACT, you must output at most 5 choices total."
)

OBJECT = (
    "STRUCT<id STRING, label STRING, cell STRING, yaw STRING, is_held BOOLEAN, kind STRING, fill STRING,"
    " stacked_on STRING, top_of_stack BOOLEAN>"
)
POSE = "STRUCT<cell STRING, yaw STRING, z STRING>"
TURN = "STRUCT<role STRING, content STRING, prompt STRING, kind STRING, choices ARRAY<STRING>, reply STRING>"
PROMPT = (
    "STRUCT<kind STRING, text STRING, choices ARRAY<STRING>, context STRUCT<type STRING, obj_id STRING, label STRING,"
    " labels ARRAY<STRING>, obj_ids ARRAY<STRING>, none_index INT, action STRING, amount STRING, alt_obj_id STRING>>"
)
ACTION = "STRUCT<tool STRING, obj STRING, amount STRING, outcome STRING>"
MEMORY = (
    f"STRUCT<n_interactions BIGINT, past_dialogs ARRAY<{TURN}>, candidates ARRAY<STRING>, last_tool_calls ARRAY<STRING>,"
    f" excluded_obj_ids ARRAY<STRING>, last_action {ACTION}, last_prompt {PROMPT}>"
)
TOOL_CALL = (
    "STRUCT<tool STRING, args STRUCT<kind STRING, text STRING, choices ARRAY<STRING>, obj STRING, amount STRING>>"
)
OBSERVATION = (
    f"STRUCT<objects ARRAY<{OBJECT}>, gripper_hist ARRAY<{POSE}>, memory {MEMORY}, user_state STRUCT<mode STRING>>"
)
DECISIONS = (
    f"episode_id BIGINT, env STRING, t BIGINT, objects ARRAY<{OBJECT}>, gripper_hist ARRAY<{POSE}>, memory {MEMORY},"
    f" user_state STRUCT<mode STRING>, target_tool_call {TOOL_CALL}"
)
DECISION_KEYS = ("episode_id", "objects", "gripper_hist", "memory", "user_state", "target_tool_call")
CONTRACT = "id STRING, instruction STRING, input STRING, output STRING"
CONTRACT_KEYS = ("id", "instruction", "input", "output")
CHAT = "id STRING, messages ARRAY<STRUCT<role STRING, content STRING>>"
AMBIGUOUS = (
    f"id STRING, env_name STRING, ambiguity_category STRING, wizard_prompt_type STRING, ambiguity_reason STRING,"
    f" oracle_baseline_call {TOOL_CALL}, " + DECISIONS
)
SESSIONS = (
    "episode_id BIGINT, env_name STRING, wizard_id STRING, intended_obj_id STRING, started_at DOUBLE, ended_at DOUBLE,"
    f" n_decisions INT, decisions ARRAY<STRUCT<tick_idx INT, alert_reason STRING, tool_call {TOOL_CALL}>>"
)
COMMAND = "type STRING, mode STRING, axis STRING, direction INT, active BOOLEAN, reason STRING, stamp DOUBLE"
RAW_OBJECT = (
    "STRUCT<id STRING, label STRING, grid_cell INT, grid_label STRING, is_held BOOLEAN, yaw DOUBLE>"
)
SNAPSHOT = (
    f"STRUCT<stamp DOUBLE, objects ARRAY<{RAW_OBJECT}>,"
    " gripper STRUCT<grid_cell INT, grid_label STRING, yaw DOUBLE, height DOUBLE>>"
)
CALL = f"t_from_start_sec DOUBLE, tool_name STRING, target_object_id STRING, state_snapshot {SNAPSHOT}"
TRIAL_INFO = "mode STRING, subject_id STRING, difficulty STRING, trial_id STRING"
TRIAL_KEYS = ("mode", "subject", "difficulty", "trial_id")
SCENARIO_OBJECT = "STRUCT<id STRING, label STRING, raw_label STRING, cell STRING, yaw STRING, is_held BOOLEAN>"
USER_PRIORS = (
    "STRUCT<translation_share DOUBLE, rotation_share DOUBLE, gripper_share DOUBLE, mean_active_burst_sec DOUBLE,"
    " mode_switches_per_sec DOUBLE, direction_reversals_per_sec DOUBLE, total_active_time_sec DOUBLE, total_commands BIGINT>"
)
SCENARIOS = (
    "scenario_id STRING, source STRUCT<mode STRING, subject STRING, difficulty STRING, trial_id STRING, trial_dir STRING>,"
    f" objects ARRAY<{SCENARIO_OBJECT}>, gripper_init {POSE}, target_obj_id STRING, target_label_source STRING,"
    f" layout_source STRING, user_priors {USER_PRIORS}, difficulty STRING, plausible_target_ids ARRAY<STRING>, notes STRING"
)
HAND_LABELS = (
    "scenario_id STRING, subject STRING, difficulty STRING, mode STRING, target_obj_id STRING, plausible_targets STRING,"
    " object_summary STRING, current_target_source STRING, layout_override STRING, notes STRING"
)
PREDICTIONS = "id STRING, raw STRING"
COUNTERS = "MAP<STRING, MAP<STRING, BIGINT>>"
CELLS = (
    "model STRUCT<name STRING, kind STRING, model_path STRING>,"
    " timing STRUCT<load_s DOUBLE, eval_s DOUBLE, examples_per_sec DOUBLE>, n BIGINT, json_valid_rate DOUBLE,"
    " schema_valid_rate DOUBLE, json_errors BIGINT, schema_errors BIGINT, tool_accuracy DOUBLE, motion_obj_accuracy DOUBLE,"
    " motion_tool_accuracy DOUBLE, interact_kind_accuracy DOUBLE, interact_choices_valid_rate DOUBLE,"
    " strict_exact_rate DOUBLE, motion_n BIGINT, interact_n BIGINT,"
    f" tool_confusion {COUNTERS}, by_context {COUNTERS}, by_mode {COUNTERS}, by_num_candidates {COUNTERS},"
    " _model_safe STRING, _eval_set STRING, _env STRING, _flavor STRING, _group STRING, _display STRING"
)
QUESTIONS = (
    "scenario_id STRING, seed INT, condition STRING, tick INT, state_hash STRING, selector STRING, k_candidates INT,"
    " n_candidates_before INT, h_before_bits DOUBLE, h_after_expected_bits DOUBLE, ig_bits DOUBLE, interact_kind STRING,"
    f" context_type_hint STRING, chosen {TOOL_CALL},"
    f" candidates ARRAY<STRUCT<sample_idx INT, tool_call {TOOL_CALL}, ig_bits DOUBLE, per_reply ARRAY<ARRAY<DOUBLE>>>>"
)
ROLLOUTS = (
    "scenario_id STRING, subject STRING, difficulty STRING, trial_mode STRING, mode STRING, condition STRING, seed INT,"
    " success INT, completion_time_sec DOUBLE, total_inputs INT, interactions INT, motion_tool_calls INT,"
    " mode_switches INT, direction_reversals INT, dropped_inputs INT, selection_perturbations INT,"
    " direction_perturbations INT, target_filtered_out INT, terminated_at_max_ticks INT, end_reason STRING"
)
CONDITION_SUMMARY = (
    "mode STRING, condition STRING, difficulty STRING, n_rollouts BIGINT, success_rate DOUBLE,"
    " mean_completion_time_sec DOUBLE, std_completion_time_sec DOUBLE, mean_total_inputs DOUBLE, std_total_inputs DOUBLE,"
    " mean_interactions DOUBLE, mean_dropped_inputs DOUBLE, mean_direction_reversals DOUBLE,"
    " mean_motion_tool_calls DOUBLE, target_filtered_out_rate DOUBLE, max_ticks_rate DOUBLE"
)
