"""Dialog tables (R3-R5, R7): rendering, validation and history pairing.

Input is the long form ``(conv_id, turn, role, text)`` with turns numbered from 0.
Rendering gathers each conversation's turns once (the rendered prompt is one
value per conversation, so nothing beyond the output itself is gathered) and
builds the pieces with higher-order functions; validity checks and history
pairing are partial-aggregating group-bys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradebook import fixed
from gradebook.functions.text import ustrip

USER_TAG = "<|User|>"
ASSISTANT_TAG = "<|Assistant|>"
DEFAULT_SYSTEM = "You are a careful assistant for IT operations. Answer helpfully and truthfully."


def _end_marker(tag: str) -> str:
    # The end-of-message marker uses the tag's third character, lower-cased.
    return f"<eo{tag[2].lower()}>"


def render_tagged(conv: DataFrame, user_tag: str = USER_TAG, assistant_tag: str = ASSISTANT_TAG,
                  sep: str = "\n", default_system: str = "") -> DataFrame:
    """``system + tag:message<eoX>sep`` per turn; an empty message leaves its tag open.

    The system turn (if any) supplies the system text; otherwise ``default_system``.  A prompt for the
    next answer therefore ends with an empty assistant turn in the dialog.
    """
    role = F.col("role")
    tag = F.when(role == "user", F.lit(user_tag)).otherwise(F.lit(assistant_tag))
    end = F.when(role == "user", F.lit(_end_marker(user_tag))).otherwise(F.lit(_end_marker(assistant_tag)))
    piece = F.when(role == "system", F.col("text")).otherwise(
        F.when(F.length("text") > 0, F.concat(tag, F.lit(":"), F.col("text"), end, F.lit(sep)))
        .otherwise(F.concat(tag, F.lit(":"))))
    # One aggregation per conversation gathers the ordered pieces and whether a
    # system turn leads; the default system text is added in the final projection.
    g = conv.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct(F.col("turn").alias("o"), piece.alias("p")))).alias("_ps"),
        F.max((role == "system") & (F.col("turn") == 0)).alias("_has_sys"))
    body = F.array_join(F.transform("_ps", lambda x: x["p"]), "")
    head = F.when(F.col("_has_sys"), F.lit("")).otherwise(F.lit(default_system))
    return g.select("conv_id", F.concat(head, body).alias("prompt"))


def dialog_checks(conv: DataFrame, with_system_text: bool = False) -> DataFrame:
    """Per conversation, strict user/assistant alternation after an optional
    leading system turn, and a last turn from the user.

    One partial-aggregating group-by: parity violations are counted under both
    hypotheses (with / without a system turn) and the right one is picked after.
    ``with_system_text`` also returns the system turn's text (``sys``) from the
    same aggregation.
    """
    role, turn = F.col("role"), F.col("turn")

    def bad(offset: int) -> Column:
        p = turn - offset
        return (F.when(role == "system", turn != 0 if offset == 1 else F.lit(True))
                .when(role == "user", p % 2 != 0)
                .when(role == "assistant", p % 2 != 1)
                .otherwise(F.lit(True))).cast("int")

    g = conv.groupBy("conv_id").agg(
        F.count("*").alias("n_turns"),
        F.max((role == "system") & (turn == 0)).alias("has_system"),
        F.sum(bad(1)).alias("bad_sys"), F.sum(bad(0)).alias("bad_nosys"),
        F.max_by(role, turn).alias("last_role"),
        F.max(turn).alias("max_turn"),
        *([F.max(F.when(role == "system", F.col("text"))).alias("sys")] if with_system_text else []))
    order_ok = (F.when(F.col("has_system"), F.col("bad_sys")).otherwise(F.col("bad_nosys")) == 0) & \
        (F.col("max_turn") == F.col("n_turns") - 1)
    return g.select("conv_id", "n_turns", "has_system", order_ok.alias("order_ok"), "last_role",
                    (order_ok & (F.col("last_role") == "user")).alias("valid"),
                    *(["sys"] if with_system_text else []))


def invalid_dialogs(conv: DataFrame) -> DataFrame:
    """R5 report: conversations a chat template would reject, with the reason."""
    c = dialog_checks(conv).filter(~F.col("valid"))
    reason = F.when(~F.col("order_ok"), F.lit("bad_order")).otherwise(F.lit("last_not_user"))
    return c.select("conv_id", "n_turns", "last_role", reason.alias("reason"))


def render_inst(conv: DataFrame, default_system: str = DEFAULT_SYSTEM) -> DataFrame:
    """Instruction-bracket rendering of valid dialogs.

    The system text (or ``default_system``) is folded into the first user turn;
    each (user, assistant) pair becomes ``<s>[INST] u [/INST] a </s>`` and the
    final user turn ``<s>[INST] u [/INST]``.

    A conversation's turns are gathered once (the rendered prompt is one value
    per conversation anyway); validity (R5 rules), the system fold and the pieces
    are then higher-order expressions over that sorted array, so the job is a
    single aggregation with no join back to the turns.
    """
    g = conv.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    m = F.col("m")
    n_all = F.size(m)
    has_sys = F.get(m, 0)["role"] == "system"
    off = F.when(has_sys, F.lit(1)).otherwise(F.lit(0))
    n = n_all - off

    def ok_at(x, i):
        p = i - off
        return ((x["turn"] == i)
                & F.when(x["role"] == "system", i == 0)
                .when(x["role"] == "user", p % 2 == 0)
                .when(x["role"] == "assistant", p % 2 == 1)
                .otherwise(F.lit(False)))

    valid = (F.forall(F.transform(m, ok_at), lambda b: b)
             & (F.get(m, n_all - 1)["role"] == "user"))
    sys_text = F.when(has_sys, F.get(m, 0)["text"]).otherwise(F.lit(default_system))

    def piece(x, i):
        p = i - off
        content = F.when(p == 0, F.concat(F.lit(fixed.B_SYS), sys_text, F.lit(fixed.E_SYS), x["text"])) \
            .otherwise(x["text"])
        u = ustrip(content)
        return (F.when(x["role"] == "system", F.lit(""))
                .when((x["role"] == "user") & (p == n - 1),
                      F.concat(F.lit(f"{fixed.BOS}{fixed.B_INST} "), u, F.lit(f" {fixed.E_INST}")))
                .when(x["role"] == "user", F.concat(F.lit(f"{fixed.BOS}{fixed.B_INST} "), u, F.lit(f" {fixed.E_INST} ")))
                .otherwise(F.concat(u, F.lit(f" {fixed.EOS}"))))

    return (g.filter(valid)
            .select("conv_id", F.array_join(F.transform(m, piece), "").alias("prompt")))


def history_pairs(conv: DataFrame) -> DataFrame:
    """Drop the first message, pair the rest as (user, assistant) history, and
    keep the last message as the current question.  ``valid`` is false when the
    remaining count is even (pairs then stop at the last complete one)."""
    n = conv.groupBy("conv_id").agg(F.count("*").alias("n"))
    c = conv.join(n, "conv_id").select("conv_id", "turn", "text", "n").filter(F.col("turn") > 0)
    q = F.col("turn") - 1
    rest = F.col("n") - 1
    c = c.select("conv_id", "text", q.alias("q"), rest.alias("rest"))
    valid = (F.col("rest") % 2 == 1)
    question = c.filter(F.col("q") == F.col("rest") - 1).select(
        "conv_id", F.lit(None).cast("long").alias("pair_idx"), F.col("text").alias("prompt_text"),
        F.lit(None).cast("string").alias("response_text"), F.lit(True).alias("is_question"), valid.alias("valid"))
    hist = (c.filter(F.col("q") < F.col("rest") - 1)
            .groupBy("conv_id", (F.col("q") / 2).cast("long").alias("pair_idx"), "rest")
            .agg(F.max(F.when(F.col("q") % 2 == 0, F.col("text"))).alias("prompt_text"),
                 F.max(F.when(F.col("q") % 2 == 1, F.col("text"))).alias("response_text"))
            .filter(F.col("prompt_text").isNotNull() & F.col("response_text").isNotNull())
            .select("conv_id", "pair_idx", "prompt_text", "response_text", F.lit(False).alias("is_question"),
                    valid.alias("valid")))
    return hist.unionByName(question)
