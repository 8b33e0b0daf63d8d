"""Best fuzzy match of company names without comparing every pair.

Similarity is the token-sort ratio: tokens sorted and joined, then
200 * LCS / (len a + len b). Names that agree after sorting are joined by
equality, those that differ by one character too many or missing by what is
left without it; no other name is as alike. The others are searched in rounds
of falling thresholds: an entry
whose best name reaches a round's threshold is done, and high thresholds need
few index entries. A round is a prefix-filtered join on numbered bigrams: two
names of ratio t share so many of them that they meet on one of the rarest few
of each, in a bucket of the lengths that t allows. Pairs too short for that
bound meet on numbered characters. A pair is looked at in its first common
group only, passes bounds on length and on the characters it lacks, and is then
scored with bit-parallel arithmetic, many names at once. Groups are split on
both sides where they are large, and emit each entry's best name, so no pair
leaves a task. No filter loses a match, for any threshold.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from finsieve.functions.text import normalise_name, strip_registry_noise, token_sorted
from finsieve.session import materialize

BLOCK = 4000
WORD = 64
#: Thresholds tried before the wanted one.
ROUNDS = (0.9, 0.8)
#: Names whose lengths differ by less than this share a bucket.
LENGTHS = 4
#: From this length on a name that differs by one character is more alike than any that differs by more.
_ONE_OFF = 3
#: Below this ratio shared bigrams are no longer certain.
_LEAST_BIGRAM = 0.72


def lcs_lengths(a: str, masks_of, columns: list[np.ndarray], n: int) -> np.ndarray:
    """LCS of ``a`` with n names at once: one bit per character, in as many 64-bit words as ``a`` needs."""
    words = -(-len(a) // WORD)
    masks = masks_of(a)
    open_bits = np.full((words, n), np.uint64(0xFFFFFFFFFFFFFFFF))
    for ids in columns:
        carry = np.zeros(n, np.uint64)
        for w in range(words):
            v = open_bits[w]
            hit = v & masks[w][ids]
            total = v + hit
            moved = total + carry
            carry = ((total < v) | (moved < total)).astype(np.uint64)
            open_bits[w] = moved | (v - hit)
    last = len(a) - (words - 1) * WORD
    closed = ~open_bits
    closed[-1] &= np.uint64((1 << last) - 1)
    return np.bitwise_count(closed).sum(axis=0).astype(np.int64)


def lcs_length(a: str, b: str) -> int:
    """LCS of two names of any length."""
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for ch in b:
        hit = v & masks.get(ch, 0)
        v = ((v + hit) | (v - hit)) & full
    return len(a) - bin(v).count("1")


def ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 200.0 * lcs_length(a, b) / total if total else 100.0


@F.pandas_udf(T.DoubleType())
def sorted_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of two token-sorted names per row; missing names score 0. Each distinct first name is scored against all of its partners at once."""
    out = np.zeros(len(a))
    there = (a.notna() & b.notna()).to_numpy()
    rows_of: dict[str, list[int]] = {}
    for i in np.flatnonzero(there).tolist():
        rows_of.setdefault(a.iat[i], []).append(i)
    for name, rows in rows_of.items():
        partners = b.iloc[rows].tolist()
        lengths = np.array([len(x) for x in partners])
        total = len(name) + lengths
        common = _Names(partners).common(name, np.arange(len(partners))) if name else np.zeros(len(partners))
        out[rows] = np.where(total > 0, 200.0 * common / np.maximum(total, 1), 100.0)
    return pd.Series(out)


def name_similarity(a: Column, b: Column) -> Column:
    """Token-sort ratio of two raw company names."""
    return sorted_ratio(token_sorted(normalise_name(a)), token_sorted(normalise_name(b)))


class _Names:
    """Names of a group in columns of character ids, to be scored against one name at a time."""

    def __init__(self, names: list[str]):
        self.alphabet = {c: i for i, c in enumerate(sorted(set("".join(names))))}
        self.lengths = np.array([len(x) for x in names], np.int64)
        self.ids = np.full((len(names), int(self.lengths.max(initial=0))), len(self.alphabet), np.int64)
        for i, x in enumerate(names):
            self.ids[i, :len(x)] = [self.alphabet[c] for c in x]
        self.present = np.array([_present(x) for x in names], np.uint64)

    def common(self, a: str, rows: np.ndarray) -> np.ndarray:
        """LCS of ``a`` with the chosen names."""
        width = int(self.lengths[rows].max(initial=0))
        ids = self.ids[rows, :width]

        def masks_of(name: str) -> np.ndarray:
            masks = np.zeros((-(-len(name) // WORD), len(self.alphabet) + 1), np.uint64)
            for i, c in enumerate(name):
                if c in self.alphabet:
                    masks[i // WORD, self.alphabet[c]] |= np.uint64(1 << i % WORD)
            return masks

        return lcs_lengths(a, masks_of, [np.ascontiguousarray(ids[:, j]) for j in range(width)], len(rows))


def _present(name: str) -> int:
    """Which characters occur, as 64 bits; characters may share one."""
    bits = 0
    for c in set(name):
        bits |= 1 << ord(c) % 64
    return bits


def numbered(name: str, size: int) -> list[str]:
    """Runs of ``size`` characters with their occurrence number, so that repeats stay distinct."""
    seen: Counter = Counter()
    out = []
    for i in range(len(name) - size + 1):
        gram = name[i:i + size]
        seen[gram] += 1
        out.append(f"{gram}{seen[gram]}")
    return out


def _ranked(names: DataFrame, size: int) -> DataFrame:
    """(offered, name, ranks): a name's numbered runs, rarest among the offered names first, as longs of count and hash."""
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def grams(name: pd.Series) -> pd.Series:
        return pd.Series([numbered(x, size) for x in name], dtype=object)

    each = names.select("offered", "name", F.explode(grams("name")).alias("e"))
    counts = each.filter("offered").groupBy("e").agg(F.count(F.lit(1)).alias("n"))
    rank = F.least(F.coalesce("n", F.lit(0)), F.lit((1 << 22) - 1)) * F.lit(1 << 40) + F.pmod(F.xxhash64("e"), F.lit(1 << 40))
    return each.join(counts, "e", "left").groupBy("offered", "name").agg(F.sort_array(F.collect_list(rank)).alias("ranks"))


def shared_runs(length: int, t: float, size: int, shortest: int = 0) -> int:
    """How many numbered runs a name of ``length`` surely shares with any partner of ratio ``t`` (whose lengths add up to ``shortest`` or more).

    With L common characters, each of the ``length - L`` others takes at most two bigrams along and each of the partner's others one, so
    3 L - (sum of lengths) - 1 bigrams stay; L is at least t / 2 of the sum.
    """
    partner = math.ceil(length * t / (2 - t) - 1e-9)
    if size == 1:
        return partner
    return max(1, math.ceil((1.5 * t - 1) * max(length + partner, shortest) - 1 - 1e-9))


def _prefix(ranked: DataFrame, t: float, size: int, shortest: int) -> DataFrame:
    """(offered, name, n, rank, prefix), one row per run among a name's rarest few."""
    @F.pandas_udf(T.IntegerType())
    def shared(n: pd.Series) -> pd.Series:
        return n.map(lambda k: shared_runs(int(k), t, size, shortest)).astype("int32")

    n = F.length("name")
    few = ranked.withColumn("n", n).withColumn("prefix", F.slice("ranks", 1, F.greatest(F.size("ranks") - shared(n) + 1, F.lit(0))))
    return few.select("offered", "name", "n", F.explode("prefix").alias("rank"), "prefix")


def _score_group(t: float):
    columns = ["name", "ratio", "match", "scored"]

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame(columns=columns)
        names = right["name"].to_numpy()
        group = _Names(names.tolist())
        rank = left["rank"].iat[0]
        # runs before this group's own, padded with one that is nowhere
        earlier = [[r for r in prefix if r < rank] for prefix in right["prefix"]]
        width = max(map(len, earlier))
        met = np.full((len(names), width), -1, np.int64)
        for i, runs in enumerate(earlier):
            met[i, :len(runs)] = runs
        out = []
        for a, prefix in zip(left["name"], left["prefix"], strict=True):
            n = len(a)
            least = np.ceil(t * (n + group.lengths) / 2 - 1e-9)
            own = np.uint64(_present(a))
            fits = (least <= np.minimum(n, group.lengths)) & (np.bitwise_count(own & ~group.present) <= n - least) & (
                np.bitwise_count(group.present & ~own) <= group.lengths - least)
            before = np.array([r for r in prefix if r < rank], np.int64)
            rows = np.flatnonzero(fits)
            if len(rows) and width and len(before):  # runs are compared only where the bounds leave a pair open
                rows = rows[~np.isin(met[rows], before).any(axis=1)]
            if len(rows) == 0:
                continue
            ratios = 200.0 * group.common(a, rows) / (n + group.lengths[rows])
            best = ratios.max()
            hit = best >= 100 * t
            out.append((a, float(best) if hit else None, min(names[rows[ratios == best]]) if hit else None, len(rows)))
        return pd.DataFrame(out, columns=columns)

    return score


def _round(prefixes: DataFrame, t: float) -> DataFrame:
    """(name, ratio, match, scored): the best offered name of every entry that meets any, and how many pairs were scored."""
    reach = F.sequence((F.floor(F.col("n") * t / (2 - t)) / LENGTHS).cast("int"), (F.ceil(F.col("n") * (2 - t) / t) / LENGTHS).cast("int"))
    l = prefixes.filter("not offered").select("rank", "name", "prefix", F.explode(reach).alias("bucket"))
    r = prefixes.filter("offered").toDF(*prefixes.columns).select("rank", "name", "prefix", (F.col("n") / LENGTHS).cast("int").alias("bucket"))
    at = ["rank", "bucket"]
    parts = l.groupBy(*at).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("lp")).join(
        r.groupBy(*at).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("rp")), at
    )

    def part(n: str) -> Column:
        return F.pmod(F.xxhash64("name"), F.col(n)).cast("int")

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    l = l.join(parts, at).select(*at, "name", "prefix", part("lp").alias("lp"), every("rp").alias("rp"))
    r = r.join(parts, at).select(*at, "name", "prefix", part("rp").alias("rp"), every("lp").alias("lp"))
    keys = (*at, "lp", "rp")
    near = l.groupBy(*keys).cogroup(r.groupBy(*keys)).applyInPandas(_score_group(t), "name string, ratio double, match string, scored long")
    top = near.groupBy("name").agg(
        F.min(F.when(F.col("ratio").isNotNull(), F.struct((-F.col("ratio")).alias("r"), "match"))).alias("b"), F.sum("scored").alias("scored")
    )
    return top.select("name", (-F.col("b.r")).alias("ratio"), "b.match", "scored")


def _without_one(name: str) -> Column:
    """The different names that are left when one character of ``name`` is taken out."""
    rest = f"transform(sequence(1, length({name})), i -> concat(substring({name}, 1, i - 1), substring({name}, i + 1)))"
    return F.expr(f"array_distinct({rest})")


def _one_off(wanted: DataFrame, offered: DataFrame, t: float) -> DataFrame:
    """(name, ratio, match, scored) of the entries with an offered name that has one character more or less, if that reaches ``t``.

    With D characters that are not common, the ratio is 1 - D / (sum of lengths): for a name of n > 2 characters at least
    1 - 1 / (2 n - 1) where D is 1, and at most 1 - 1 / (n + 1) where it is more.
    """
    wanted = wanted.filter(F.length("name") >= _ONE_OFF).select("name")
    offered = offered.select(F.col("name").alias("match"))

    def by_hash(names: DataFrame, whole: str) -> DataFrame:
        return names.select(whole, F.xxhash64(whole).alias("h"))

    def shortened(names: DataFrame, whole: str) -> DataFrame:
        return names.select(whole, F.explode(_without_one(whole)).alias("rest")).select(whole, F.xxhash64("rest").alias("h"))

    more = by_hash(wanted, "name").join(shortened(offered, "match"), "h").filter(F.array_contains(_without_one("match"), F.col("name")))
    fewer = shortened(wanted, "name").join(by_hash(offered, "match"), "h").filter(F.array_contains(_without_one("name"), F.col("match")))
    n, m = F.length("name"), F.length("match")
    pairs = more.unionByName(fewer).select("name", "match", (F.lit(200.0) * F.least(n, m) / (n + m)).alias("ratio"))
    best = pairs.groupBy("name").agg(F.min(F.struct((-F.col("ratio")).alias("r"), "match")).alias("b"), F.count(F.lit(1)).alias("scored"))
    return best.select("name", (-F.col("b.r")).alias("ratio"), "b.match", "scored").filter(F.col("ratio") >= 100 * t)


def searched_names(entries: DataFrame, choices: DataFrame, threshold: float) -> DataFrame:
    """(name, ratio, match, scored) of all rounds: found names have a ratio; ``scored`` counts the pairs looked at closely."""
    last = threshold / 100.0
    names = materialize(
        entries.select(F.lit(False).alias("offered"), "name").filter("name <> ''").distinct().unionByName(
            choices.select(F.lit(True).alias("offered"), "name").filter("name <> ''").distinct()), "match-names",
    )
    wanted, offered = names.filter("not offered"), names.filter("offered")
    equal = wanted.join(offered.select("name"), "name", "left_semi").select("name", F.lit(100.0).alias("ratio"), F.col("name").alias("match"), F.lit(0).cast("long").alias("scored"))
    found = materialize(equal, "match-found")
    open_names = materialize(wanted.join(found.select("name"), "name", "left_anti").select("name"), "match-open")
    near = materialize(_one_off(open_names, offered, last), "match-one-off")
    found = found.unionByName(near)
    open_names = materialize(open_names.join(near, "name", "left_anti"), "match-open")
    ranked = {}
    for t in [*(x for x in ROUNDS if x > last), last]:
        if open_names.isEmpty():
            break
        if t >= _LEAST_BIGRAM:
            shortest = math.ceil(2 / (1.5 * t - 1))
            searches = [(2, F.lit(True), shortest), (1, F.length("name") < shortest, 0)]
        else:
            searches = [(1, F.lit(True), 0)]
        results = None
        for size, chosen, shortest in searches:
            if size not in ranked:
                ranked[size] = materialize(_ranked(names, size), "match-ranked")
            some = ranked[size].filter(chosen)
            asked = some.filter("not offered").join(open_names, "name", "left_semi").unionByName(some.filter("offered"), allowMissingColumns=True)
            got = _round(_prefix(asked.select("offered", "name", "ranks"), t, size, shortest), t)
            results = got if results is None else results.unionByName(got)
        best = results.groupBy("name").agg(
            F.min(F.when(F.col("ratio").isNotNull(), F.struct((-F.col("ratio")).alias("r"), "match"))).alias("b"), F.sum("scored").alias("scored")
        )
        landed = materialize(best.select("name", (-F.col("b.r")).alias("ratio"), "b.match", "scored"), "match-round")
        found = found.unionByName(landed)
        open_names = materialize(open_names.join(landed.filter("ratio is not null"), "name", "left_anti"), "match-open")
    return found


def best_names(entries: DataFrame, choices: DataFrame, threshold: float) -> DataFrame:
    """(name, ratio, match) for each distinct entry name with a match.

    Both inputs hold token-sorted names in ``name``. Highest ratio wins, then
    the first name in alphabetical order.
    """
    return searched_names(entries, choices, threshold).filter("ratio is not null").select("name", "ratio", "match")


def match_releases(releases: DataFrame, master: DataFrame, threshold: float = 82.0) -> DataFrame:
    """Releases (aaer_no, fraud_date, raw_name) to companies of the master.

    One best company per release, then one release per company: the highest
    score, then the lowest release number.
    """
    entries = releases.withColumn("name", token_sorted(normalise_name(F.col("raw_name"))))
    companies = master.withColumn("name", token_sorted(normalise_name(F.col("title")))).filter("name <> ''")
    one_each = companies.groupBy("name").agg(F.min(F.struct("cik", "ticker", "title")).alias("c"))
    pairs = best_names(entries, one_each, threshold)
    matched = (
        entries.join(pairs, "name").join(one_each.withColumnRenamed("name", "match"), "match")
        .select("c.cik", "c.ticker", F.col("c.title").alias("company_name"), "aaer_no", "fraud_date",
                F.col("raw_name").alias("raw_aaer_name"), F.round("ratio", 1).alias("match_score"))
    )
    order = F.struct(
        (-F.col("match_score")).alias("s"), F.coalesce("aaer_no", F.lit(2**31 - 1)).alias("a"), "fraud_date", "raw_aaer_name"
    )
    rest = F.struct("ticker", "company_name", "aaer_no", "fraud_date", "raw_aaer_name", "match_score")
    return matched.groupBy("cik").agg(F.min_by(rest, order).alias("b")).select("cik", "b.*")


def resolve_seeds(seeds: DataFrame, master: DataFrame, filers: DataFrame, date: str) -> DataFrame:
    """Seeds (seed_no, company_name, ticker, <date>) to companies.

    A ticker hit counts when the names are at least 60 alike (tickers get
    reassigned). Otherwise the most similar filer of an annual report, at
    least 65 alike after registry tags are removed. The first seed of a
    company stays; a ticker hit scores 100, a name hit 90.
    """
    by_ticker = (
        seeds.withColumn("ticker", F.upper("ticker")).join(master, "ticker")
        .filter(name_similarity(F.col("company_name"), F.col("title")) >= 60)
        .select("seed_no", date, "cik", "ticker", F.col("title").alias("company_name"), F.lit(100.0).alias("match_score"))
    )
    open_seeds = seeds.join(by_ticker.select("seed_no"), "seed_no", "left_anti").withColumn(
        "name", token_sorted(normalise_name(F.col("company_name")))
    )
    annual = filers.filter(F.exists("forms", lambda f: f.startswith("10-K"))).withColumn(
        "clean", strip_registry_noise(F.col("title"))
    ).withColumn("name", token_sorted(normalise_name(F.col("clean"))))
    one_each = annual.groupBy("name").agg(F.min(F.struct("cik", "clean")).alias("c"))
    pairs = best_names(open_seeds, one_each, 65.0)
    by_name = (
        open_seeds.join(pairs, "name").join(one_each.withColumnRenamed("name", "match"), "match")
        .select("seed_no", date, "c.cik", F.lit("").alias("ticker"), F.col("c.clean").alias("company_name"),
                F.lit(90.0).alias("match_score"))
    )
    found = by_ticker.unionByName(by_name)
    kept = F.struct("ticker", "company_name", date, "match_score")
    return found.groupBy("cik").agg(F.min_by(kept, "seed_no").alias("b")).select("cik", "b.*")
