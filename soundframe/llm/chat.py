"""Preference formatting: one prompt and two masked completions per pair of conversations.

A conversation is paired with another one that shares as many first turns as any other does: conversations are put in order of the digests
of their turns, where those that share the most stand next to each other. Where nothing is shared, the rejected conversation has the reply
that another one gave in a like context in place of its last. The longest common prefix of whole turns of the chosen and the rejected
conversation is rendered once as the prompt; what follows in each is a completion. A completion's mask lists the character spans that
count for the loss: the text and end mark of assistant turns. All of it is built-in functions, over one row per pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from soundframe.llm.common import free, numbered, read, written

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def rendered(turns: Column) -> Column:
    return F.transform(turns, lambda t: F.concat(F.lit(OPEN), t.role, F.lit("\n"), t.text, F.lit(CLOSE + "\n")))


def mask(turns: Column) -> Column:
    """Spans start:end of assistant turns in the rendered text, comma-joined; the role line and the newline don't count."""
    size = lambda t: F.length(t.role) + F.length(t.text) + len(OPEN) + len(CLOSE) + 2
    start = F.aggregate(
        turns,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans")),
        lambda a, t: F.struct(
            (a.at + size(t)).alias("at"),
            F.when(t.role == "assistant", F.array_append(a.spans, F.concat_ws(":", (a.at + F.length(t.role) + len(OPEN) + 1).cast("string"), (a.at + size(t) - 1).cast("string")))).otherwise(a.spans).alias("spans"),
        ),
        lambda a: F.array_join(a.spans, ","),
    )
    return start


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id and turns, an array of (role, text) in order of turn, then role and text.

    Null roles read unknown, null texts are empty, turns with a null conv_id are one conversation; repeated rows are turns of their own, next to
    each other; texts may be of any length; other columns are ignored; an empty table gives an empty result.
    """
    t = turns.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    return t.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list("t")), lambda t: F.struct(t.role.alias("role"), t.text.alias("text"))).alias("turns"))


def format_preferences(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """Replaces two columns of turn arrays by n_prompt_turns, prompt, chosen, rejected, chosen_mask and rejected_mask.

    Equal conversations give two empty completions; without a common first turn the prompt is empty; if one is the beginning of
    the other its completion is empty. Neither column is null; other columns stay, but for those with the names of the new ones; repeated rows stay; texts may be of any length; an
    empty table gives an empty result.
    """
    differ = F.array_position(F.zip_with(chosen, rejected, lambda a, b: a.eqNullSafe(b)), False)  # the shorter side is filled with nulls
    made = ("n_prompt_turns", "prompt", "chosen", "rejected", "chosen_mask", "rejected_mask")
    keep = [c for c in pairs.columns if c not in (chosen, rejected) and c.lower() not in made]
    n = F.when(differ == 0, F.size(chosen)).otherwise(differ - 1).cast("int")
    p = pairs.select(*keep, F.struct(F.col(chosen).alias("c"), F.col(rejected).alias("r"), n.alias("n")).alias(free(pairs, "_turns")))
    of = lambda c: F.col(f"{p.columns[-1]}.{c}")
    rest = lambda c: F.slice(of(c), of("n") + 1, F.size(of(c)))
    return p.select(*keep, of("n").cast("long").alias("n_prompt_turns"), F.array_join(rendered(F.slice(of("c"), F.lit(1), of("n"))), "").alias("prompt"), F.array_join(rendered(rest("c")), "").alias("chosen"), F.array_join(rendered(rest("r")), "").alias("rejected"), mask(rest("c")).alias("chosen_mask"), mask(rest("r")).alias("rejected_mask"))


def last_reply() -> dict[str, Column]:
    """Of turns: the place of the last assistant turn from 0 (null if there is none), its text, and the text before it."""
    place = F.array_position(F.reverse(F.transform("turns", lambda t: t.role == "assistant")), True)  # from the end
    last = F.when(place > 0, F.size("turns") - place).cast("int")
    return {"_last": last, "_reply": F.get("turns", last).text, "_context": F.coalesce(F.when(last > 0, F.get("turns", last - 1).text), F.lit(""))}


def other_replies(convs: DataFrame, replies: DataFrame) -> DataFrame:
    """(conv_id, chosen, rejected, source) of convs: rejected has another text in place of its last assistant turn's.

    replies (_key, _other) has texts that others gave (source is context); without one it is the conversation's assistant text before, or
    half the last one if there is none (own). A conversation without an assistant turn is rejected as it is: two empty completions.
    """
    c = convs.withColumns(last_reply()).join(replies, "_key", "left")
    before = F.filter("turns", lambda t: t.role == "assistant")
    half = F.substr("_reply", F.lit(1), F.floor(F.length("_reply") / 2).cast("int"))
    text = F.coalesce("_other", F.when(F.size(before) > 1, F.get(before, F.size(before) - 2).text).otherwise(half))
    c = c.withColumn("_text", text)
    rejected = F.transform("turns", lambda t, i: F.when(i == F.col("_last"), F.struct(t.role.alias("role"), F.col("_text").alias("text"))).otherwise(t))
    return c.select("conv_id", F.col("turns").alias("chosen"), rejected.alias("rejected"), F.when(F.col("_other").isNotNull(), "context").otherwise("own").alias("source"))


def neighbours(df: DataFrame, order: list[str], columns: list[str]) -> DataFrame:
    """df with _after and _before, structs of columns of the rows next to each in that order (null at the ends).

    Rows are numbered by range partitions and meet by neighbouring numbers, so that no group of rows is gathered.
    """
    n = written(numbered(df, order), "ordered")
    beside = lambda step, name: n.select((F.col("number") - step).alias("number"), F.struct(*columns).alias(name))
    return n.join(beside(1, "_after"), "number", "left").join(beside(-1, "_before"), "number", "left").drop("number")


def partners(different: DataFrame) -> DataFrame:
    """(_key, _partner, shared) of different conversations (_key, digests): the one beside each in order of digests that shares more first turns."""

    def common(other: str) -> Column:
        differ = F.array_position(F.zip_with("digests", other, lambda a, b: a.eqNullSafe(b)), False)
        return F.when(F.col(other).isNull(), 0).when(differ > 0, differ - 1).otherwise(F.least(F.size("digests"), F.size(other)))

    p = neighbours(different.select("_key", "digests"), ["digests"], ["_key", "digests"])
    p = p.select("_key", "_after", "_before", common("_after.digests").alias("a"), common("_before.digests").alias("b"))
    best = F.when((F.col("a") >= F.col("b")) & (F.col("a") > 0), F.col("_after._key")).when(F.col("b") > 0, F.col("_before._key"))
    return p.select("_key", best.alias("_partner"), F.greatest("a", "b").alias("shared"))


def preference_pairs(convs: DataFrame) -> DataFrame:
    """(conv_id, chosen, rejected, source), one row per conversation; source is prefix where rejected is another whole conversation.

    Conversations carry no preferences; the one whose row it is counts as chosen. Equal ones are counted as one first, so however many there
    are each is paired with a different one. An empty table gives an empty result.
    """
    digests = F.transform("turns", lambda t: F.md5(F.concat(t.role, F.lit("\n"), t.text).cast("binary")))
    convs = written(convs.withColumn("digests", digests).withColumn("_key", F.md5(F.array_join("digests", ",").cast("binary"))), "conversations")
    different = written(convs.groupBy("_key").agg(F.any_value("turns").alias("turns"), F.any_value("digests").alias("digests")), "different")
    found = written(partners(different), "partners")
    asked = different.join(found.where("_partner is null"), "_key", "left_semi")
    replies = different.withColumns(last_reply()).where("_last is not null").select("_key", "_context", "_reply")
    n = neighbours(replies, ["_context", "_key"], ["_reply"]).join(asked.select("_key"), "_key", "left_semi")
    unlike = lambda c: F.when(F.col(f"{c}._reply") != F.col("_reply"), F.col(f"{c}._reply"))
    other = written(n.select("_key", F.coalesce(unlike("_after"), unlike("_before")).alias("_other")), "replies")
    turns = different.select(F.col("_key").alias("_partner"), F.col("turns").alias("rejected"))
    pairs = found.where("_partner is not null").join(turns, "_partner").select("_key", "rejected")
    real = convs.join(pairs, "_key").select("conv_id", F.col("turns").alias("chosen"), "rejected", F.lit("prefix").alias("source"))
    return real.unionByName(other_replies(convs.join(asked.select("_key"), "_key", "left_semi"), other))


def query_chat(spark, sf_dir: str) -> DataFrame:
    return format_preferences(preference_pairs(conversations(read(spark, sf_dir, "conversations"))))


SQL = """
WITH t AS (SELECT conv_id, dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS cid, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) AS k FROM conversations),
q AS (SELECT cid, list(md5(role || chr(10) || text) ORDER BY k) AS seq FROM t GROUP BY cid),
rep AS (SELECT seq, md5(array_to_string(seq, ',')) AS key, min(cid) AS cid FROM q GROUP BY seq),
d AS (SELECT *, lead(seq) OVER (ORDER BY seq) AS aseq, lag(seq) OVER (ORDER BY seq) AS bseq FROM rep),
n AS (SELECT *, coalesce(len(list_filter(range(1, least(len(seq), len(aseq)) + 1), lambda i: seq[1 : i] = aseq[1 : i])), 0) AS la, coalesce(len(list_filter(range(1, least(len(seq), len(bseq)) + 1), lambda i: seq[1 : i] = bseq[1 : i])), 0) AS lb FROM d),
p AS (SELECT q.cid, other.cid AS partner FROM q JOIN n ON n.seq = q.seq LEFT JOIN rep other ON other.seq = CASE WHEN la >= lb AND la > 0 THEN aseq WHEN lb > 0 THEN bseq END),
a AS (SELECT *, max(CASE WHEN role = 'assistant' THEN k END) OVER (PARTITION BY cid) AS last FROM t),
b AS (SELECT *, max(CASE WHEN role = 'assistant' AND k < last THEN k END) OVER (PARTITION BY cid) AS prev FROM a),
c AS (SELECT *, max(CASE WHEN k = prev THEN text END) OVER (PARTITION BY cid) AS older FROM b),
l AS (SELECT rep.seq, rep.key, max(CASE WHEN k = last THEN text END) AS reply, coalesce(max(CASE WHEN k = last - 1 THEN text END), '') AS ctx FROM rep JOIN c ON c.cid = rep.cid WHERE last IS NOT NULL GROUP BY ALL),
o AS (SELECT seq, CASE WHEN lead(reply) OVER w <> reply THEN lead(reply) OVER w WHEN lag(reply) OVER w <> reply THEN lag(reply) OVER w END AS other FROM l WINDOW w AS (ORDER BY ctx, key)),
r AS (SELECT c.cid, k, role, CASE WHEN k = last THEN coalesce(other, older, substr(text, 1, length(text) // 2)) ELSE text END AS text FROM c JOIN p ON p.cid = c.cid JOIN q ON q.cid = c.cid LEFT JOIN o ON o.seq = q.seq WHERE partner IS NULL
    UNION ALL SELECT p.cid, k, role, text FROM p JOIN t ON t.cid = p.partner),
u AS (SELECT p.cid, any_value(t.conv_id) AS conv_id, CASE WHEN any_value(partner) IS NOT NULL THEN 'prefix' WHEN any_value(other) IS NOT NULL THEN 'context' ELSE 'own' END AS source FROM p JOIN t ON t.cid = p.cid JOIN q ON q.cid = p.cid LEFT JOIN o ON o.seq = q.seq GROUP BY p.cid),
m AS (SELECT cid, k, t.role AS grole, t.text AS gtext, r.role AS hrole, r.text AS htext FROM t FULL JOIN r USING (cid, k)),
e AS (SELECT *, coalesce(min(CASE WHEN grole IS DISTINCT FROM hrole OR gtext IS DISTINCT FROM htext THEN k END) OVER (PARTITION BY cid), 1000000000) AS differ FROM m),
f AS (SELECT *, '<|im_start|>' || grole || chr(10) || gtext || '<|im_end|>' || chr(10) AS g, '<|im_start|>' || hrole || chr(10) || htext || '<|im_end|>' || chr(10) AS h FROM e),
s AS (SELECT *, coalesce(sum(CASE WHEN k >= differ THEN length(g) END) OVER w, 0) AS gend, coalesce(sum(CASE WHEN k >= differ THEN length(h) END) OVER w, 0) AS hend FROM f
    WINDOW w AS (PARTITION BY cid ORDER BY k ROWS UNBOUNDED PRECEDING))
SELECT any_value(conv_id) AS conv_id, any_value(source) AS source, CAST(count(*) FILTER (k < differ) AS BIGINT) AS n_prompt_turns,
    coalesce(string_agg(g, '' ORDER BY k) FILTER (k < differ), '') AS prompt,
    coalesce(string_agg(g, '' ORDER BY k) FILTER (k >= differ), '') AS chosen,
    coalesce(string_agg(h, '' ORDER BY k) FILTER (k >= differ), '') AS rejected,
    coalesce(string_agg(CAST(gend - length(g) + 13 + length(grole) AS VARCHAR) || ':' || CAST(gend - 1 AS VARCHAR), ',' ORDER BY k) FILTER (k >= differ AND grole = 'assistant'), '') AS chosen_mask,
    coalesce(string_agg(CAST(hend - length(h) + 13 + length(hrole) AS VARCHAR) || ':' || CAST(hend - 1 AS VARCHAR), ',' ORDER BY k) FILTER (k >= differ AND hrole = 'assistant'), '') AS rejected_mask
FROM s JOIN u USING (cid) GROUP BY cid
"""
