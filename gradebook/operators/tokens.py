"""Judge token accounting (T2-T4) over judgment logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradebook import fixed
from gradebook.functions.tokens import Tokenizer, constant_counts, message_tokens, regex_tokens

ROLES = ("system", "user", "assistant")


def _constants(spark, catalog: dict[str, dict], tokenizer: Tokenizer) -> tuple[dict, Column]:
    """Role-name counts and a name -> system-prompt count lookup.

    With the JVM regex tokenizer these are expressions over literals, which
    Catalyst constant-folds at planning time (no job, no per-row work).  A Python
    tokenizer cannot be folded, so its counts come from one tiny job instead.
    """
    if tokenizer is regex_tokens:
        roles = {r: r for r in ROLES}          # message_tokens tokenizes the literal role
        sys_map = F.create_map(*[x for n, t in catalog.items()
                                 for x in (F.lit(n), regex_tokens(F.lit(t["system_prompt"])))])
        return roles, sys_map
    texts = {f"role:{r}": r for r in ROLES}
    texts.update({f"sys:{n}": t["system_prompt"] for n, t in catalog.items()})
    counts = constant_counts(spark, texts, tokenizer)
    roles = {r: counts[f"role:{r}"] for r in ROLES}
    sys_map = F.create_map(*[x for n in catalog for x in (F.lit(n), F.lit(counts[f"sys:{n}"]).cast("long"))])
    return roles, sys_map


def _bench(bench: str | None) -> Column:
    return F.col("bench") if bench is None else F.lit(bench)


def token_detail(single: DataFrame | None, pair: DataFrame | None, catalog: dict[str, dict],
                 judge_model: str = "gpt-3.5-turbo", bench: str | None = None,
                 tokenizer: Tokenizer = regex_tokens, models: list[str] | None = None) -> DataFrame:
    """One row per single judgment and two per pair judgment (g1, g2).

    The system prompt is looked up by each row's judge prompt name (not always
    the plain one), so the count follows the prompt actually used.  ``models``
    keeps single judgments of those models and pair judgments whose two models
    are both listed.  The bench of a row is its column of that name, unless ``bench`` gives one for all.
    """
    from gradebook.operators.matches import filter_models
    if single is not None:
        single = filter_models(single, models)
    if pair is not None:
        pair = filter_models(pair, models, ("model_1", "model_2"))
    spark = (single if single is not None else pair).sparkSession
    roles, sys_map = _constants(spark, catalog, tokenizer)
    sys_tokens = F.coalesce(F.try_element_at(sys_map, F.col("judge_prompt")), F.raise_error(
        F.concat(F.lit("no judge prompt of this name in the catalog: "), F.coalesce("judge_prompt", F.lit("null")))).cast("long"))

    def io(user: Column, judgment: Column) -> tuple[Column, Column]:
        # input = system + user messages, output = the assistant message.
        inp = message_tokens([(roles["system"], 0), (roles["user"], user)], judge_model, tokenizer) + sys_tokens
        out = message_tokens([(roles["assistant"], judgment)], judge_model, tokenizer)
        return inp, out

    parts = []
    if single is not None:
        i, o = io(F.col("user_prompt"), F.col("judgment"))
        parts.append(single.select(
            _bench(bench).alias("bench"), F.lit("single").alias("mode"), "question_id",
            F.col("model").alias("model_key"), F.lit(0).alias("game"), "judge_model",
            i.alias("input_tokens"), o.alias("output_tokens")))
    if pair is not None:
        games = F.explode(F.array(
            F.struct(F.lit(1).alias("game"), F.col("g1_user_prompt").alias("u"), F.col("g1_judgment").alias("j")),
            F.struct(F.lit(2).alias("game"), F.col("g2_user_prompt").alias("u"), F.col("g2_judgment").alias("j"))))
        p = pair.select("question_id", _bench(bench).alias("bench"), "judge_model", "judge_prompt",
                        F.concat(F.least("model_1", "model_2"), F.lit(","), F.greatest("model_1", "model_2"))
                        .alias("model_key"), games.alias("g"))
        i, o = io(F.col("g.u"), F.col("g.j"))
        parts.append(p.select(
            "bench", F.lit("pair").alias("mode"), "question_id", "model_key",
            F.col("g.game").alias("game"), "judge_model", i.alias("input_tokens"), o.alias("output_tokens")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def conversation_tokens(messages: DataFrame, key: str, role: str = "role", content: str = "content", judge_model: str = "gpt-3.5-turbo",
                        tokenizer: Tokenizer = regex_tokens) -> DataFrame:
    """T1 over message rows: tokens per conversation.  Each message is counted where it lies and only numbers are added up, so
    no conversation is gathered."""
    one = message_tokens([(F.col(role), F.col(content))], judge_model, tokenizer) - F.lit(fixed.REPLY_PRIMING_TOKENS)
    return messages.select(key, one.alias("n")).groupBy(key).agg((F.sum("n") + F.lit(fixed.REPLY_PRIMING_TOKENS)).cast("long").alias("n_tokens"))


def token_totals(detail: DataFrame) -> DataFrame:
    """T4: totals per (bench, mode, model or unordered model pair) in one group-by."""
    return detail.groupBy("bench", "mode", "model_key").agg(
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
        F.count("*").alias("n"))
