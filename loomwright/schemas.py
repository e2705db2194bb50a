"""Schemas of the engine's tables, as Spark DDL."""

SYMBOLS = (
    "symbol_id STRING, path STRING, module STRING, name STRING, kind STRING, parent STRING, start_line INT, end_line INT, docstring STRING, "
    "calls ARRAY<STRING>, decorators ARRAY<STRING>, num_calls INT"
)
IMPORTS = "path STRING, module STRING, imports ARRAY<STRING>, num_defs INT, num_imports INT, has_test_flag BOOLEAN"
NODES = (
    "id STRING, node_type STRING, name STRING, path STRING, module STRING, symbol_id STRING, start_line INT, end_line INT, docstring STRING, "
    "num_calls INT, decorators ARRAY<STRING>, num_defs INT, num_imports INT, has_test_flag BOOLEAN, ord LONG"
)
MESSAGES = "ARRAY<STRUCT<role: STRING, content: STRING>>"
ALIGNED = f"_prompt {MESSAGES}, _response {MESSAGES}, _system STRING, _tools STRING, _images ARRAY<STRING>, _videos ARRAY<STRING>, _audios ARRAY<STRING>"
QA = (
    "id STRING, question STRING, answer ARRAY<STRING>, answer_type STRING, graph_support STRUCT<path: ARRAY<STRING>, edges: ARRAY<ARRAY<STRING>>>, "
    "num_hops INT, verified BOOLEAN, relavant_files ARRAY<STRING>"
)
TRAINER_LOG = (
    "current_steps LONG, total_steps LONG, loss DOUBLE, eval_loss DOUBLE, predict_loss DOUBLE, reward DOUBLE, accuracy DOUBLE, lr DOUBLE, epoch DOUBLE, "
    "percentage DOUBLE, elapsed_time STRING, remaining_time STRING, throughput DOUBLE, total_tokens LONG"
)
EVAL_RESULT = "results MAP<STRING, MAP<STRING, STRING>>, metrics MAP<STRING, STRING>"
