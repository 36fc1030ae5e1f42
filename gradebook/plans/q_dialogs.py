"""Dialog queries (R3-R5, R7, T1 over dialogs) on the conversations table."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradebook import fixed
from gradebook.functions.templates import sql_literal
from gradebook.operators import dialogs as D
from gradebook.operators.tokens import conversation_tokens
from gradebook.plans import fixtures as fx
from gradebook.plans.registry import register
from gradebook.plans.sql_snippets import ustrip_sql

_U, _A = D.USER_TAG, D.ASSISTANT_TAG


@register("dialog_prompt", f"""
WITH c AS (SELECT *, bool_or(role = 'system' AND turn = 0) OVER (PARTITION BY conv_id) AS has_sys FROM conversations),
p AS (
  SELECT conv_id, CAST(turn AS BIGINT) AS turn,
    CASE WHEN role = 'system' THEN text
         WHEN length(text) > 0 THEN (CASE WHEN role = 'user' THEN {sql_literal(_U)} ELSE {sql_literal(_A)} END)
              || ':' || text || (CASE WHEN role = 'user' THEN '<eou>' ELSE '<eoa>' END) || chr(10)
         ELSE (CASE WHEN role = 'user' THEN {sql_literal(_U)} ELSE {sql_literal(_A)} END) || ':' END AS piece
  FROM c
  UNION ALL SELECT conv_id, -1, '' FROM c WHERE NOT has_sys AND turn = 0)
SELECT conv_id, string_agg(piece, '' ORDER BY turn) AS prompt FROM p GROUP BY conv_id""")
def dialog_prompt(spark, sf):
    return D.render_tagged(fx.table(spark, sf, "conversations"))


def _bad(offset: int) -> str:
    sys_bad = "turn <> 0" if offset == 1 else "TRUE"
    return (f"CAST(CASE WHEN role = 'system' THEN {sys_bad} WHEN role = 'user' THEN (turn - {offset}) % 2 <> 0 "
            f"WHEN role = 'assistant' THEN (turn - {offset}) % 2 <> 1 ELSE TRUE END AS INTEGER)")


_CHECKS = f"""g AS (
  SELECT conv_id, count(*) AS n_turns, bool_or(role = 'system' AND turn = 0) AS has_system,
         sum({_bad(1)}) AS bad_sys, sum({_bad(0)}) AS bad_nosys, arg_max(role, turn) AS last_role,
         max(turn) AS max_turn
  FROM conversations GROUP BY conv_id),
chk AS (
  SELECT conv_id, n_turns, has_system,
         (CASE WHEN has_system THEN bad_sys ELSE bad_nosys END) = 0 AND max_turn = n_turns - 1 AS order_ok,
         last_role FROM g),
checks AS (SELECT *, order_ok AND last_role = 'user' AS valid FROM chk)"""


@register("dialog_checks", f"""
WITH {_CHECKS}
SELECT * FROM checks""")
def dialog_checks(spark, sf):
    return D.dialog_checks(fx.table(spark, sf, "conversations"))


@register("dialog_invalid", f"""
WITH {_CHECKS}
SELECT conv_id, n_turns, last_role, CASE WHEN NOT order_ok THEN 'bad_order' ELSE 'last_not_user' END AS reason
FROM checks WHERE NOT valid""")
def dialog_invalid(spark, sf):
    return D.invalid_dialogs(fx.table(spark, sf, "conversations"))


_INST_U = lambda u: ustrip_sql(u)


@register("dialog_inst", f"""
WITH {_CHECKS},
c AS (SELECT v.*, k.has_system, k.n_turns,
             coalesce(max(CASE WHEN v.role = 'system' THEN v.text END) OVER (PARTITION BY v.conv_id),
                      {sql_literal(D.DEFAULT_SYSTEM)}) AS sys
      FROM conversations v JOIN checks k ON v.conv_id = k.conv_id WHERE k.valid),
d AS (SELECT conv_id, turn, role, n_turns - CASE WHEN has_system THEN 1 ELSE 0 END AS n,
             turn - CASE WHEN has_system THEN 1 ELSE 0 END AS p,
             CASE WHEN turn - CASE WHEN has_system THEN 1 ELSE 0 END = 0
                  THEN {sql_literal(fixed.B_SYS)} || sys || {sql_literal(fixed.E_SYS)} || text ELSE text END AS content
      FROM c),
e AS (SELECT conv_id, turn,
        CASE WHEN role = 'system' THEN ''
             WHEN role = 'user' AND p = n - 1 THEN {sql_literal(fixed.BOS + fixed.B_INST + " ")} || {_INST_U("content")} || {sql_literal(" " + fixed.E_INST)}
             WHEN role = 'user' THEN {sql_literal(fixed.BOS + fixed.B_INST + " ")} || {_INST_U("content")} || {sql_literal(" " + fixed.E_INST + " ")}
             ELSE {_INST_U("content")} || {sql_literal(" " + fixed.EOS)} END AS piece FROM d)
SELECT conv_id, string_agg(piece, '' ORDER BY turn) AS prompt FROM e GROUP BY conv_id""")
def dialog_inst(spark, sf):
    return D.render_inst(fx.table(spark, sf, "conversations"))


@register("dialog_history", """
WITH c AS (SELECT conv_id, turn, text, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
r AS (SELECT conv_id, text, turn - 1 AS q, n - 1 AS rest FROM c WHERE turn > 0),
h AS (SELECT conv_id, CAST(q // 2 AS BIGINT) AS pair_idx, rest,
             max(CASE WHEN q % 2 = 0 THEN text END) AS prompt_text,
             max(CASE WHEN q % 2 = 1 THEN text END) AS response_text
      FROM r WHERE q < rest - 1 GROUP BY conv_id, q // 2, rest)
SELECT conv_id, pair_idx, prompt_text, response_text, FALSE AS is_question, rest % 2 = 1 AS valid
FROM h WHERE prompt_text IS NOT NULL AND response_text IS NOT NULL
UNION ALL
SELECT conv_id, CAST(NULL AS BIGINT), text, CAST(NULL AS VARCHAR), TRUE, rest % 2 = 1 FROM r WHERE q = rest - 1""")
def dialog_history(spark, sf):
    return D.history_pairs(fx.table(spark, sf, "conversations"))


_TOK = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"


@register("dialog_tokens", f"""
SELECT conv_id, CAST(sum(3 + len(regexp_extract_all(role, '{_TOK}')) + len(regexp_extract_all(text, '{_TOK}'))) + 3
                     AS BIGINT) AS n_tokens
FROM conversations GROUP BY conv_id""")
def q_dialog_tokens(spark, sf):
    return conversation_tokens(fx.table(spark, sf, "conversations"), "conv_id", content="text", judge_model="gpt-4")
