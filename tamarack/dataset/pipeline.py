"""Question and statement pairs as a dataset: screening, conflicts, equivalence groups, splits, leakage, records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack.evaluation.shape import statement_tables
from tamarack.operators.components import components
from tamarack.operators.ranking import bucket_rank
from tamarack.operators.skew import hot_aware_join
from tamarack.storage import materialize


def normal_text(text: Column) -> Column:
    """Lower case, blanks collapsed."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def screen(pairs: DataFrame, question: str = "question", sql: str = "sql", rows: str = "row_count", error: str = "error") -> DataFrame:
    """Adds ``reason``, the first that fits, null for a sound pair: empty_question, empty_sql, not_read_only, failed, empty_result, duplicate.

    Of equal pairs the one with the smallest id stays; the others are duplicates.
    """
    key = F.md5(F.concat_ws("\x1f", F.coalesce(normal_text(F.col(question)), F.lit("\x00")), F.coalesce(normal_text(F.col(sql)), F.lit("\x00"))))
    keyed = pairs.withColumn("__key", key)
    first = materialize(keyed.groupBy("__key").agg(F.min("id").alias("__first"), F.count("*").alias("__n")))
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    reason = (
        F.when(blank(question), "empty_question")
        .when(blank(sql), "empty_sql")
        .when(~F.col(sql).rlike(r"(?is)^\s*(select|with)\b") | F.col(sql).rlike(r"(?i)\b(insert|update|delete|drop|alter|create|truncate)\s"), "not_read_only")
        .when(F.col(error).isNotNull(), "failed")
        .when(F.coalesce(F.col(rows), F.lit(0)) == 0, "empty_result")
        .when(F.col("id") > F.col("__first"), "duplicate")
    )
    return hot_aware_join(keyed, first, ["__key"], "__n", pairs.count()).withColumn("reason", reason).select(*pairs.columns, "reason")


def screen_fully(pairs: DataFrame, known_tables: list[str]) -> DataFrame:
    """(id, reason) of pairs (id, question, sql, fingerprint, row_count, error): why a pair is left out, null for one that stays.

    The first that fits: empty_question, empty_sql, unparseable, dangerous_sql (a statement
    that writes), unknown_table, failed, empty_result; of what passes so far duplicate_pair
    (all but the smallest id of the same question and statement), and of the rest
    conflicting_question, every pair of a question with several statements or results.
    """
    read = statement_tables(pairs.select("id", "question", "sql", "fingerprint", "row_count", F.col("error").cast("string").alias("error")))
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    reason = (
        F.when(blank("question"), "empty_question")
        .when(blank("sql"), "empty_sql")
        .when(F.col("sql").rlike(r"(?i)^[\s(]*(insert|update|delete|merge|drop|create|alter|truncate|grant|revoke|call|copy)\b"), "dangerous_sql")
        .when(F.col("tables").isNull(), "unparseable")
        .when(F.size(F.array_except("tables", F.array(*map(F.lit, known_tables)))) > 0, "unknown_table")
        .when(F.col("error").isNotNull(), "failed")
        .when(F.coalesce("row_count", F.lit(0)) == 0, "empty_result")
    )
    asked, said = F.md5(F.trim("question")), F.md5(normal_text(F.col("sql")))
    first = materialize(read.select("id", "fingerprint", reason.alias("reason"), asked.alias("q"), said.alias("s")))
    passed = first.where("reason is null")
    # one pair stays of each question and statement, so a question conflicts where it has several statements
    results = materialize(passed.groupBy("q", "s").agg(F.min("id").alias("keep"), F.count("*").alias("n")))
    conflict = results.groupBy("q").agg((F.count("*") > 1).alias("conflict"))
    judged = materialize(results.join(conflict, "q").select("q", "s", "keep", "conflict", "n"))
    late = F.when(F.col("id") != F.col("keep"), "duplicate_pair").when(F.col("conflict"), "conflicting_question")
    total = first.count()
    out = hot_aware_join(passed, judged, ["q", "s"], "n", total).select("id", late.alias("reason"))
    return first.where("reason is not null").select("id", "reason").unionByName(out)


def question_conflicts(pairs: DataFrame, question: str = "question", sql: str = "sql", result: str = "fingerprint") -> DataFrame:
    """Questions that are asked of more than one statement or have more than one result."""
    grouped = pairs.groupBy(normal_text(F.col(question)).alias("question")).agg(F.countDistinct(normal_text(F.col(sql))).alias("statements"), F.countDistinct(result).alias("results"))
    return grouped.where("statements > 1 or results > 1")


def result_collisions(pairs: DataFrame, sql: str = "sql", result: str = "fingerprint") -> DataFrame:
    """Results that different statements share."""
    return pairs.where(F.col(result).isNotNull()).groupBy(F.col(result).alias("result")).agg(F.countDistinct(normal_text(F.col(sql))).alias("statements")).where("statements > 1")


def equivalence_groups(pairs: DataFrame, key: str = "template_id", sql: str = "sql", **bounds: int) -> DataFrame:
    """(value, grp): values of ``key`` that share a statement, directly or through others, are one group."""
    links = pairs.where(F.col(key).isNotNull() & F.col(sql).isNotNull()).select(F.concat(F.lit("k:"), F.col(key)).alias("a"), F.concat(F.lit("s:"), F.md5(normal_text(F.col(sql)))).alias("b"))
    return components(links, **bounds).where("node like 'k:%'").select(F.substring("node", 3, 1 << 30).alias("value"), F.substring("root", 3, 1 << 30).alias("grp"))


def deal(lack: list[float], n: int, groups: int) -> list[int]:
    """How many of ``groups`` groups of ``n`` rows each split gets, one after the other to the largest deficit; ``lack`` is lowered by what they hold.

    Many groups go at once, down to the level to which giving one by one would bring all splits.
    """
    got = [0] * len(lack)
    if groups > 2 * len(lack):
        at = sorted(range(len(lack)), key=lambda i: -lack[i])
        for m in range(len(at), 0, -1):
            level = (sum(lack[i] for i in at[:m]) - n * groups) / m
            if lack[at[m - 1]] >= level:
                break
        for i in at[:m]:
            got[i] = max(0, min(int((lack[i] - level) // n), groups - sum(got)))
            lack[i] -= n * got[i]
    while sum(got) < groups:
        i = max(range(len(lack)), key=lambda k: (lack[k], -k))
        got[i] += 1
        lack[i] -= n
    return got


def stratified_split(groups: DataFrame, shares: tuple[float, float, float] = (0.70, 0.15, 0.15)) -> DataFrame:
    """(grp, tier, split) for groups (grp, tier, n): within a tier, largest first, each to the split with the largest deficit.

    Groups of one size are interchangeable, so a task holds the different sizes of a tier, of
    which there are few, and never its groups. A null tier counts as an empty one.
    """
    import pyarrow as pa

    names = ("train", "validation", "test")

    def assign(tier: pa.Table) -> pa.Table:
        rows = sorted(tier.to_pylist(), key=lambda r: -r["n"])
        total = sum(r["n"] * r["groups"] for r in rows)
        lack = [round(10_000 * s) * total for s in shares]  # whole numbers, so that ties are ties
        got = [deal(lack, 10_000 * r["n"], r["groups"]) for r in rows]
        return pa.table({"tier": pa.array([r["tier"] for r in rows], pa.string()), "n": pa.array([r["n"] for r in rows], pa.int64()), "groups": pa.array([r["groups"] for r in rows], pa.int64()), "got": pa.array(got, pa.list_(pa.int64()))})

    sized = materialize(groups.select("grp", F.coalesce("tier", F.lit("")).alias("tier"), F.col("n").cast("long").alias("n")))
    total = sized.count()
    given = materialize(sized.groupBy("tier", "n").agg(F.count("*").alias("groups")).groupBy("tier").applyInArrow(assign, "tier string, n bigint, groups bigint, got array<bigint>"))
    ranked = materialize(bucket_rank(sized, ["tier", "n"], ["grp"], total_rows=total))
    dealt = hot_aware_join(ranked, given, ["tier", "n"], "groups", total)
    train, validation = F.col("got")[0], F.col("got")[1]
    return dealt.select("grp", "tier", F.when(F.col("rank") < train, names[0]).when(F.col("rank") < train + validation, names[1]).otherwise(names[2]).alias("split"))


def pinned_split(groups: DataFrame, pinned: DataFrame) -> DataFrame:
    """(grp, split, conflict): a group keeps the split of its pinned members, new ones train; ``conflict`` where members disagree."""
    held = pinned.groupBy("grp").agg(F.min("split").alias("first"), F.countDistinct("split").alias("k"))
    return groups.join(held, "grp", "left").select("grp", F.coalesce("first", F.lit("train")).alias("split"), (F.coalesce("k", F.lit(0)) > 1).alias("conflict"))


def leakage(rows: DataFrame, value: str, split: str = "split") -> DataFrame:
    """Values that are in more than one split."""
    return rows.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.array_sort(F.collect_set(split)).alias("splits")).where(F.size("splits") > 1)


def chat_records(pairs: DataFrame, system: str, question: str = "question", sql: str = "sql", schema: str | None = None) -> DataFrame:
    """(id, messages, meta): one conversation a pair; a rendered ``schema`` stands before each question."""
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return pairs.select("id", F.array(message("system", F.lit(system)), message("user", F.col(question) if schema is None else F.concat(F.lit(f"{schema}\n\n"), F.col(question))), message("assistant", F.col(sql))).alias("messages"), F.struct(*(c for c in pairs.columns if c not in ("id", question, sql))).alias("meta"))


def record_checks(records: DataFrame, held_out: DataFrame) -> DataFrame:
    """(check, failed): the integrity checks of chat records against held-out questions."""
    roles = F.transform("messages", lambda m: m["role"])
    text = lambda i: F.col("messages")[i]["content"]
    tests = {
        "three messages": F.size("messages") != 3,
        "order of roles": roles != F.array(F.lit("system"), F.lit("user"), F.lit("assistant")),
        "empty question": F.coalesce(F.trim(text(1)), F.lit("")) == "",
        "empty answer": F.coalesce(F.trim(text(2)), F.lit("")) == "",
        "answer is no query": ~F.coalesce(text(2), F.lit("")).rlike(r"(?is)^\s*(select|with)\b"),
        "fence in answer": F.coalesce(text(2), F.lit("")).contains("```"),
    }
    counted = records.agg(*(F.count_if(c).alias(n) for n, c in tests.items()), (F.count("*") - F.countDistinct("id")).alias("repeated ids"))
    names = [*tests, "repeated ids"]
    one = counted.select(F.explode(F.array(*(F.struct(F.lit(n).alias("check"), F.col(f"`{n}`").alias("failed")) for n in names))).alias("c")).select("c.*")
    seen = held_out.select(F.md5(normal_text(F.col("question"))).alias("q")).distinct()
    shared = records.select(F.md5(normal_text(text(1))).alias("q")).join(seen, "q", "left_semi").agg(F.lit("in held-out questions").alias("check"), F.count("*").alias("failed"))
    return one.unionByName(shared)


#: What only evaluation knows and no prompt may say.
FORBIDDEN = ("template_id", "gold_sql", "difficulty", "query_type", "fingerprint", "slot_values")


def split_checks(records: DataFrame, system: str, schema: str) -> DataFrame:
    """(split, check, failed): the checks of records (id, messages, question, sql, template_id, split) that ``record_checks`` leaves out.

    Within train and validation: the answer is the validated statement, without comments; the
    whole schema and nothing of the evaluation in the prompt, the same instruction, no
    repeated pairs or questions. Between splits: no question, statement or template of the
    test set, and none of train in validation. What repeats or is shared counts once a value.
    """
    text = lambda i: F.col("messages")[i]["content"]
    prompt = F.lower(F.concat_ws("\n", text(0), text(1)))
    one = F.col("split") != "test"
    tests = {
        "answer is not the validated statement": ~text(2).eqNullSafe(F.col("sql")),
        "comment in answer": F.coalesce(text(2), F.lit("")).rlike("--|```"),
        "schema not whole": ~F.coalesce(F.contains(text(1), F.lit(schema)), F.lit(False)),
        "other instruction": ~text(0).eqNullSafe(F.lit(system)),
        "evaluation data in prompt": reduce(lambda a, b: a | b, [F.contains(prompt, F.lit(t)) for t in FORBIDDEN]),
        "id in prompt": F.contains(F.concat_ws("\n", text(0), text(1)), F.col("id")),
    }
    counted = records.where(one).groupBy("split").agg(*(F.count_if(c).alias(n) for n, c in tests.items()))
    out = counted.select("split", F.explode(F.array(*(F.struct(F.lit(n).alias("check"), F.col(f"`{n}`").alias("failed")) for n in tests))).alias("c")).select("split", "c.*")
    statement = F.md5(normal_text(F.col("sql")))
    keys = {"question": F.md5("question"), "statement": statement, "template": F.md5("template_id"), "pair": F.md5(F.concat_ws("\x1f", "question", statement))}
    held = None
    for name, key in keys.items():
        each = records.select(F.lit(name).alias("key"), key.alias("v"), "split").where("v is not null")
        held = each if held is None else held.unionByName(each)
    # one shuffle for all keys: how often each split has each value
    n = lambda s: F.count_if(F.col("split") == s).alias(s)
    by_value = held.groupBy("key", "v").agg(n("train"), n("validation"), n("test"))
    found = [F.when((F.col("key") == k) & (F.col(s) > 1), F.struct(F.lit(s).alias("split"), F.lit(f"repeated {k}").alias("check"))) for k in ("pair", "question") for s in ("train", "validation")]
    found += [F.when((F.col("key") == k) & (F.col(s) > 0) & (F.col("test") > 0), F.struct(F.lit(s).alias("split"), F.lit(f"{k} in test").alias("check"))) for k in ("question", "statement", "template") for s in ("train", "validation")]
    found += [F.when((F.col("key") == k) & (F.col("train") > 0) & (F.col("validation") > 0), F.struct(F.lit("validation").alias("split"), F.lit(f"{k} in train").alias("check"))) for k in ("question", "template")]
    shared = by_value.select(F.explode(F.array_compact(F.array(*found))).alias("c")).select("c.*").groupBy("split", "check").agg(F.count("*").alias("failed"))
    return out.where("failed > 0").unionByName(shared)


def length_stats(records: DataFrame, text: Column) -> DataFrame:
    """n, mean, largest and nearest-rank p99 of the number of blank-separated words."""
    from tamarack.evaluation.metrics import latency

    words = records.select(F.size(F.split(F.trim(text), r"\s+")).cast("double").alias("words"))
    return latency(words, "words", 0.99).select("n", "mean", "high", "p99")
