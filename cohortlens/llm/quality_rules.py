"""Quality rules whose cutoffs are chosen on labelled documents with a guarantee. DataFrame operations only.

Each rule is a ratio of two counts of a text and rejects above a cutoff (or below, for short words). For every stratum,
rule and cutoff of a fixed grid, the good labelled documents that the cutoff would reject are counted; a cutoff is
admissible if so few would be so unlikely at a false-rejection rate of ``alpha`` (shared among the rules) that the exact
binomial tail stays below ``delta`` divided by the number of all cutoffs tried in all strata (Bonferroni). Then with
probability 1 - delta no stratum loses more than ``alpha`` of its good documents. Of a rule's admissible cutoffs the one
that gains most is taken: the rejected share of bad documents less ``cost`` times that of good ones. A rule without an
admissible cutoff that gains rejects nothing.

``nested`` spends the guarantee on one family of cutoffs for each stratum instead: bad documents and a fifth of the good
ones choose each rule's best cutoff and the order of the rules; the family adds the rules in that order, each from its
laxest cutoff to its best one, so that every member rejects what the one before it does. The other good documents test
the members in turn at the full ``alpha`` and ``delta`` divided by the strata only (fixed-sequence testing), so some 280
good labels are enough for a handful of strata. The member that gains most among those that pass is taken.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.draws import draw_bits
from .common import free_name, written

#: White space that parts words.
GAP = "\\x20\\x09-\\x0D"
#: Low bits of a packed window that hold its place in the text; a text of more words has all its windows compared as words.
PLACE = 27
#: One good document in so many chooses the nested family; the others test it.
DESIGN = 5

#: name: (numerator, denominator, cutoffs in thousandths; "below" rejects under the cutoff).
RULES = {
    "symbols": ("n_symbols", "word_chars", "above", [*range(10, 200, 10), *range(200, 1000, 50)]),
    "dup_lines": ("n_dup_lines", "n_lines", "above", [*range(20, 200, 20), *range(200, 1000, 50)]),
    "repeats": ("n_repeat_words", "n_words", "above", [*range(20, 200, 20), *range(200, 1000, 50)]),
    "long_words": ("word_chars", "n_words", "above", [*range(6000, 20000, 500)]),
    "short_words": ("word_chars", "n_words", "below", [*range(2000, 6000, 200)]),
}


def metrics(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """Columns ``keep`` and n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words of every text."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    core = F.btrim(t, F.lit(" \t\n\x0b\f\r"))
    made = docs.select(*keep, t.alias("_t"), core.alias("_core")).select(
        *keep,
        F.when(F.length("_core") > 0, F.split("_core", f"[{GAP}]+")).otherwise(F.array().cast("array<string>")).alias("_w"),
        F.length(F.regexp_replace("_t", r"[^#*$%&|<>]+", "")).cast("bigint").alias("n_symbols"),
        F.filter(F.split("_t", "\n"), lambda x: x.rlike(f"[^{GAP}]")).alias("_l"))
    made = made.select("*", F.size("_w").cast("bigint").alias("n_words"), F.length(F.array_join("_w", "")).cast("bigint").alias("word_chars"),
                       F.size("_l").cast("bigint").alias("n_lines"),
                       (F.size("_l") - F.size(F.array_distinct("_l"))).cast("bigint").alias("n_dup_lines"))
    word = lambda i: F.get("_w", i)
    # a three-word window is packed as (hash, place), so one sort of integers brings equal windows together
    packed = F.transform(F.slice("_w", F.lit(1), F.greatest(F.size("_w") - 2, F.lit(0))),
                         lambda w, i: F.shiftleft(F.xxhash64(w, word(i + 1), word(i + 2)), PLACE).bitwiseOR(i.cast("bigint")))
    made = made.withColumn("_k", F.sort_array(packed))
    tag = lambda k: F.shiftright(k, PLACE)
    place = lambda k: k.bitwiseAND(F.lit((1 << PLACE) - 1)).cast("int")
    made = made.withColumn("_d", F.filter("_k", lambda k, j: (tag(k) == tag(F.get("_k", j - 1))) | (tag(k) == tag(F.get("_k", j + 1)))))
    same = lambda a, b: (word(a) == word(b)) & (word(a + 1) == word(b + 1)) & (word(a + 2) == word(b + 2))
    # words are compared in full: neighbours of one hash that differ send the text the longer way
    clash = F.exists(F.transform("_d", lambda k, j: (tag(k) == tag(F.get("_d", j - 1))) & ~same(place(k), place(F.get("_d", j - 1)))), lambda x: x)
    long_ = F.size("_w") > (1 << PLACE)
    made = made.withColumn("_clash", long_ | F.coalesce(clash, F.lit(False)))
    at = F.when(long_, F.sequence(F.lit(0), F.size("_w") - 3)).otherwise(F.transform("_d", place))
    strings = F.array_sort(F.transform(at, lambda p: F.struct(word(p).alias("a"), word(p + 1).alias("b"), word(p + 2).alias("c"), p.alias("p"))))
    made = made.withColumn("_s", F.when(F.col("_clash"), strings))
    alike = lambda x, y: (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])
    exact = F.transform(F.filter("_s", lambda x, j: F.coalesce(alike(x, F.get("_s", j - 1)), F.lit(False)) | F.coalesce(alike(x, F.get("_s", j + 1)), F.lit(False))), lambda x: x["p"])
    made = made.withColumn("_p", F.sort_array(F.when(F.col("_clash"), exact).otherwise(F.transform("_d", place))))
    covered = F.aggregate(F.transform("_p", lambda p, j: F.least(F.lit(3), F.coalesce(F.get("_p", j + 1), p + 3) - p)), F.lit(0), lambda a, x: a + x)
    return made.select(*keep, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", covered.cast("bigint").alias("n_repeat_words"))


def log_gamma(x: Column) -> Column:
    """ln Gamma(x) for x >= 1, by Stirling's series eight steps further."""
    y = x + 8
    series = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * F.pow(y, F.lit(5.0)))
    product = x
    for i in range(1, 8):
        product = product * (x + i)
    return series - F.log(product)


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) of Binomial(n, p) where k < n p, else 1; terms are summed downwards from k, past 40 deviations they are 0."""
    x, m = k.cast("double"), n.cast("double")
    top = log_gamma(m + 1) - log_gamma(x + 1) - log_gamma(m - x + 1) + x * math.log(p) + (m - x) * math.log1p(-p)
    steps = F.least(k, (40 * F.sqrt(m * p) + 100).cast("bigint"))
    down = F.sequence(F.lit(0).cast("bigint"), steps)
    start = F.struct(F.lit(1.0).alias("t"), F.lit(0.0).alias("s"))
    total = F.aggregate(down, start, lambda a, i: F.struct(
        (a["t"] * (x - i) * (1 - p) / ((m - x + i + 1) * p)).alias("t"), (a["s"] + a["t"]).alias("s")), lambda a: a["s"])
    return F.when(x < m * p, F.exp(top) * total).otherwise(F.lit(1.0))


def _rejects(den: str, num: str, side: str, cutoff: Column) -> Column:
    left, right = F.col(num) * 1000, cutoff * F.col(den)
    return left > right if side == "above" else left < right


def _sides(rule: tuple) -> tuple[str, str, str]:
    num, den, side, _ = rule
    return den, num, side


def cutoffs(measured: DataFrame, labels: DataFrame, id: str, stratum: str, quality: str = "quality", alpha: float = 0.02, delta: float = 0.05,
            cost: float = 20.0, rules: dict = RULES) -> DataFrame:
    """(stratum, rule, cutoff): the chosen cutoffs in thousandths, one row for each stratum and rule that has one.

    All labelled rows count. A document with several labels is good if any says so; rows without a label are left out.
    """
    lab = labels.where(F.col(quality).isNotNull() & F.col(id).isNotNull()).groupBy(F.col(id).alias("_id")).agg((F.max(quality) > 0).alias("good"))
    held = measured.where("not base_failed").join(lab, measured[id] == lab["_id"]).select(F.col(stratum).alias("stratum"), "good", *sorted({c for r in rules.values() for c in r[:2]}))
    levels = []
    for name, (num, den, side, grid) in rules.items():
        grid = sorted(grid, reverse=side == "below")  # from lax to strict is from the end to the start
        passed = F.size(F.filter(F.array(*[F.lit(g).cast("bigint") for g in grid]), lambda g: _rejects(den, num, side, g)))
        levels.append(F.struct(F.lit(name).alias("rule"), passed.alias("passed"), F.array(*[F.lit(g).cast("bigint") for g in grid]).alias("grid")))
    rows = held.select("stratum", "good", F.inline(F.array(*levels)))
    counted = rows.groupBy("stratum", "rule", "passed").agg(F.sum(F.col("good").cast("bigint")).alias("g"), F.sum((~F.col("good")).cast("bigint")).alias("b"), F.any_value("grid").alias("grid"))
    counted = written(counted, "holdout")
    total = counted.groupBy("stratum", "rule").agg(F.sum("g").alias("n"), F.sum("b").alias("m"))
    tried = counted.where("passed > 0").select("stratum", "rule", "g", "b", F.posexplode(F.slice("grid", F.lit(1), F.col("passed"))).alias("at", "cutoff"))
    tried = tried.groupBy("stratum", "rule", "cutoff").agg(F.sum("g").alias("k"), F.sum("b").alias("kb")).join(total.withColumnsRenamed({"stratum": "s", "rule": "r"}), F.col("stratum").eqNullSafe(F.col("s")) & (F.col("rule") == F.col("r")))
    strata = counted.select("stratum").distinct().agg(F.count(F.lit(1)).alias("strata"))
    hypotheses = sum(len(r[3]) for r in rules.values())
    # one row of one number
    tests = max(1, strata.first()[0]) * hypotheses
    tail = binomial_tail(F.col("k"), F.col("n"), alpha / len(rules))
    gap = F.coalesce(F.col("kb") / F.nullif(F.col("m"), F.lit(0)), F.lit(0.0)) - cost * F.col("k") / F.greatest(F.col("n"), F.lit(1))
    lax = F.when(F.col("rule").isin([r for r, x in rules.items() if x[2] == "below"]), -F.col("cutoff")).otherwise(F.col("cutoff"))
    good = tried.where(F.col("n") > 0).where(tail <= delta / tests).where(gap > 0)
    return good.groupBy("stratum", "rule").agg(F.max_by("cutoff", F.struct(F.round(gap, 9), lax)).alias("cutoff"))


def nested_cutoffs(measured: DataFrame, labels: DataFrame, id: str, stratum: str, quality: str = "quality", alpha: float = 0.02, delta: float = 0.05,
                   cost: float = 20.0, rules: dict = RULES) -> DataFrame:
    """(stratum, rule, cutoff) as cutoffs() gives, from one nested family for each stratum.

    All labelled rows count; rows of one id are all in the part that chooses or all in the part that tests.
    """
    lab = labels.where(F.col(quality).isNotNull() & F.col(id).isNotNull()).groupBy(F.col(id).alias("_id")).agg((F.max(quality) > 0).alias("good"))
    held = measured.where("not base_failed").join(lab, measured[id] == lab["_id"])
    use = F.when(~F.col("good"), "bad").when(draw_bits(F.col("_id")) % DESIGN == 0, "design").otherwise("test")
    # steps run from the laxest cutoff (0); a row's step in a rule is the first that rejects it, null if none does
    steps = {r: sorted(x[3], reverse=x[2] == "above") for r, x in rules.items()}
    first = lambda r: F.array_position(F.transform(F.array(*[F.lit(g).cast("bigint") for g in steps[r]]), lambda g: _rejects(*_sides(rules[r]), g)), True)
    at = [F.nullif(first(r), F.lit(0)).cast("int").alias(f"_at_{r}") for r in rules]
    rows = written(held.select(F.col(stratum).alias("stratum"), use.alias("use"), *at).groupBy("stratum", "use", *[f"_at_{r}" for r in rules]).agg(F.count(F.lit(1)).alias("rows")), "holdout")
    size = lambda u, c="rows": F.sum(F.when(F.col("use") == u, F.col(c)).otherwise(F.lit(0)))
    total = written(rows.groupBy("stratum").agg(size("bad").alias("m"), size("design").alias("nd"), size("test").alias("n")), "strata")
    same = F.col("stratum").eqNullSafe(F.col("s"))
    sizes = total.withColumnRenamed("stratum", "s")

    cells = F.array(*[F.struct(F.lit(i).alias("rule"), F.col(f"_at_{r}").alias("step"), F.lit(len(steps[r])).alias("last")) for i, r in enumerate(rules)])
    hit = rows.select("stratum", "use", "rows", F.inline(cells)).where("step is not null").groupBy("stratum", "rule", "last", "step").agg(size("bad").alias("b"), size("design").alias("d"))
    hit = hit.select("stratum", "rule", "b", "d", F.explode(F.sequence("step", "last")).alias("step")).groupBy("stratum", "rule", "step").agg(F.sum("b").alias("b"), F.sum("d").alias("d"))
    gap = F.coalesce(F.col("b") / F.nullif(F.col("m"), F.lit(0)), F.lit(0.0)) - cost * F.col("d") / F.greatest(F.col("nd"), F.lit(1))
    best = hit.join(sizes, same).withColumn("gap", F.round(gap, 9)).where("gap > 0").groupBy("stratum", "rule").agg(F.max(F.struct("gap", -F.col("step"))).alias("x"))
    best = best.select("stratum", F.struct((-F.col("x.gap")).alias("g"), "rule", (-F.col("x.col2")).alias("best")).alias("x"))
    order = written(best.groupBy(F.col("stratum").alias("s")).agg(F.array_sort(F.collect_list("x")).alias("order")), "family")

    # a member of the family is (place of the rule it has reached) * wide + step
    wide = max(len(g) for g in steps.values()) + 1
    step_of = F.array(*[F.col(f"_at_{r}") for r in rules])
    reached = F.array_min(F.transform("order", lambda x, i: F.when(F.get(step_of, x["rule"]) <= x["best"], i * wide + F.get(step_of, x["rule"]))))
    counts = rows.join(order, same).select("stratum", "use", "rows", reached.alias("member")).where("member is not null").groupBy("stratum", "member").agg(size("bad").alias("b"), size("test").alias("k"))
    # a member between two of those at which rows fall rejects what the one before rejects; a stratum has at most one row for each cutoff
    sums = Window.partitionBy("stratum").orderBy("member")
    tried = counts.select("stratum", "member", F.sum("b").over(sums).alias("kb"), F.sum("k").over(sums).alias("k")).join(sizes, same)
    # one row of one number
    strata = max(1, total.count())
    gain = F.coalesce(F.col("kb") / F.nullif(F.col("m"), F.lit(0)), F.lit(0.0)) - cost * F.col("k") / F.greatest(F.col("n"), F.lit(1))
    passed = tried.where("n > 0").where(binomial_tail(F.col("k"), F.col("n"), alpha) <= delta / strata).where(gain > 0)
    taken = passed.groupBy("stratum").agg(F.max_by("member", F.struct(F.round(gain, 9), -F.col("member"))).alias("member")).join(order, same)
    place, step = F.floor(F.col("member") / wide).cast("int"), F.pmod(F.col("member"), F.lit(wide)).cast("int")
    chain = F.transform(F.slice("order", F.lit(1), place + 1), lambda x, i: F.struct(x["rule"].alias("rule"), F.when(i == place, step).otherwise(x["best"]).alias("step")))
    names = F.array(*[F.lit(r) for r in rules])
    grids = F.array(*[F.array(*[F.lit(g).cast("bigint") for g in steps[r]]) for r in rules])
    return taken.select("stratum", F.inline(chain)).select("stratum", F.get(names, F.col("rule")).alias("rule"), F.get(F.get(grids, F.col("rule")), F.col("step") - 1).alias("cutoff"))


def judge(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", stratum: str = "lang", quality: str = "quality",
          alpha: float = 0.02, delta: float = 0.05, cost: float = 20.0, keep: list[str] | None = None, rules: dict = RULES,
          nested: bool = False) -> DataFrame:
    """Per row: id, (keep,) n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, base_failed, kept, rejected_by.

    Runs jobs: counts of all texts are written once to the shared folder; the cutoffs come from all labelled rows. A null
    or empty text has counts of 0 and fails the base rule. A null stratum is a stratum; a null id is judged like others
    but has no label. Repeated rows are judged each and, labelled, count each. Without labels no rule rejects. Texts of any
    length count whole; an empty table gives no rows; of other columns only ``keep`` is read, so their names may clash.
    """
    own, layer = free_name(docs, "stratum_of_row"), [id, *(keep or [])]
    measured = metrics(docs.withColumn(own, docs[stratum].cast("string")), text, [*layer, own])
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    measured = written(measured.withColumn("base_failed", failed), "measured")
    chosen = (nested_cutoffs if nested else cutoffs)(measured, labels, id, own, quality, alpha, delta, cost, rules)
    wide = chosen.groupBy(F.col("stratum").alias("_s")).agg(*[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"_c_{r}") for r in rules])
    out = measured.join(wide, F.col(own).eqNullSafe(F.col("_s")), "left")
    by = F.array_compact(F.array(*[F.when(_rejects(den, num, side, F.col(f"_c_{r}")), F.lit(r)) for r, (num, den, side, _) in rules.items()]))
    out = out.withColumn("rejected_by", by)
    return out.select(*layer, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "base_failed",
                      (~F.col("base_failed") & (F.size("rejected_by") == 0)).alias("kept"), "rejected_by")
