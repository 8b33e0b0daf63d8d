import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from finsieve.functions import text as tx
from finsieve.operators import ingest, match
from finsieve.plans import dataset
from finsieve.sources import facts as fx
from finsieve.sources import masters, pages as pg, sinks
from finsieve.streaming import refresh


def obs(end, val, filed, start=None, form="10-K"):
    return {k: v for k, v in dict(start=start, end=end, val=val, filed=filed, form=form, accn=f"a-{filed}").items() if v is not None}


DOC = {
    "entityName": "Acme Corp", "cik": 42,
    "facts": {"us-gaap": {
        "Assets": {"label": "Assets", "units": {"USD": [
            obs("2018-12-31", 10, "2019-02-01"), obs("2018-12-31", 11, "2020-02-01"), obs("2019-12-31", 20, "2020-02-01"),
            obs("2019-12-31", 99, "2020-03-01", form="10-K/A"), obs("not a date", 5, "2020-02-01"),
        ], "EUR": [obs("2017-12-31", 7, "2018-02-01")]}},
        "Revenues": {"units": {"USD": [
            obs("2018-12-31", 100, "2019-02-01", "2018-01-01"), obs("2018-12-31", 25, "2019-02-01", "2018-10-01"),
            obs("2017-12-31", 90, "2018-02-01", "2017-01-01"),
        ]}},
        "RevenueFromContractWithCustomerExcludingAssessedTax": {"units": {"USD": [obs("2019-12-31", 120, "2020-02-01", "2019-01-01")]}},
        "Unrelated": {"units": {"USD": [obs("2019-12-31", 1, "2020-02-01")]}},
    }},
}


@pytest.fixture()
def facts_dir(tmp_path):
    folder = tmp_path / "facts"
    folder.mkdir()
    (folder / "0000000042.json").write_text(json.dumps(DOC, indent=1))
    (folder / "0000000099.json").write_text('{"cik": 99, "facts": {broken')
    return str(folder)


def values(df):
    return {(r["concept"], r["year"]): r["value"] for r in df.collect()}


def test_extract_facts(spark, facts_dir):
    docs = fx.read_facts(spark, facts_dir)
    good, bad = fx.split_rejects(docs)
    assert [r["cik"] for r in good.collect()] == ["0000000042"] and bad.count() == 1
    got = values(dataset.long_facts(docs))
    # the preferred revenue tag has one year only; the company's other years under the older tag are lost
    assert got == {("total_assets", 2018): 11.0, ("total_assets", 2019): 20.0, ("revenue", 2019): 120.0}
    per_year = values(dataset.long_facts(docs, tag_policy="per_year"))
    assert per_year[("revenue", 2018)] == 100.0 and per_year[("revenue", 2017)] == 90.0
    earlier = values(dataset.long_facts(docs, as_of="2019-12-31"))
    assert earlier == {("total_assets", 2018): 10.0, ("revenue", 2017): 90.0, ("revenue", 2018): 100.0}


@pytest.mark.parametrize("start, single, bulk", [
    ("2019-02-15", True, True), ("2019-03-05", False, False), ("2018-10-15", True, False), ("2018-09-15", False, False), ("bad", True, True), (None, True, True),
])
def test_period_rules_differ_by_profile(spark, start, single, bulk):
    df = spark.createDataFrame([(start, "2019-12-31", "10-K")], "start string, end string, form string")
    assert (fx.annual(df, "single").count() == 1) is single
    assert (fx.annual(df, "bulk").count() == 1) is bulk


def test_full_build(spark, facts_dir, tmp_path):
    (tmp_path / "master.json").write_text(json.dumps({"0": {"cik_str": 42, "ticker": "acme", "title": "Acme Corp"}, "1": {"cik_str": 99, "ticker": "bad", "title": "Bad"}}))
    fraud = spark.createDataFrame([("42",)], "cik string").withColumn("fraud_date", F.to_date(F.lit("2019-12-31")))
    out = dataset.build(spark, facts_dir, str(tmp_path / "master.json"), str(tmp_path / "out"), fraud=fraud, min_years=2)
    summary = out["summary"].first()
    assert (summary["companies"], summary["rows"], summary["fraud"], summary["features"]) == (1, 2, 2, 53)
    with pytest.raises(ValueError):
        dataset.build(spark, facts_dir, str(tmp_path / "master.json"), str(tmp_path / "none"), min_years=9)


def test_stream_refreshes_touched_companies(spark, facts_dir, tmp_path):
    store, reports, check = (str(tmp_path / n) for n in ("store", "reports", "check"))
    def master(session):
        return session.createDataFrame([("0000000042", "ACME", "Acme Corp"), ("0000000043", "BETA", "Beta")], "cik string, ticker string, title string")
    refresh.start(spark, facts_dir, store, reports, check, master, once=True).awaitTermination()
    first = refresh.current_reports(spark, reports).collect()
    assert [r["cik"] for r in first] == ["0000000042"]
    other = {**DOC, "cik": 43, "entityName": "Beta"}
    (tmp_path / "facts" / "0000000043.json").write_text(json.dumps(other))
    refresh.start(spark, facts_dir, store, reports, check, master, once=True).awaitTermination()
    assert sorted(r["cik"] for r in refresh.current_reports(spark, reports).collect()) == ["0000000042", "0000000043"]
    # a replayed batch leaves the result unchanged
    before = refresh.current_reports(spark, reports).orderBy("cik").collect()
    docs = spark.read.schema(fx.facts_schema(fx.all_tags(fx.SINGLE))).option("multiLine", True).json(f"{facts_dir}/0000000043.json").select(
        "*", F.lit("0000000043.json").alias("file"), F.lit(None).cast("string").alias("_corrupt"))
    refresh.run_batch(master, store, reports)(docs, 1)
    assert refresh.current_reports(spark, reports).orderBy("cik").collect() == before


def test_master_and_universe(spark, tmp_path):
    text = json.dumps({"0": {"cik_str": 5, "ticker": "abc", "title": "A"}, "1": {"cik_str": 6, "ticker": "ABC", "title": "B"}})
    m = masters.parse_master(spark.createDataFrame([(text,)], "value string"))
    assert [tuple(r) for r in m.collect()] == [("0000000006", "ABC", "B")]
    found, missing = ingest.lookup_cik(spark.createDataFrame([(" abc ",), ("zzz",)], "ticker string"), m)
    assert (found.count(), missing.count()) == (1, 1)
    table = spark.createDataFrame([("BRK.B ",), (None,)], "Symbol string")
    assert [r[0] for r in masters.ticker_universe([(table, "Symbol")]).collect()] == ["BRK-B"]
    assert [r[0] for r in masters.ticker_universe([], m, use_master=True).collect()] == ["ABC"]
    assert masters.ticker_universe([], m, use_master=True, limit=0).count() == 0
    seeds = masters.seed_table(spark, [("Acme", 2012, None)], "fraud_date", 12, 31)
    assert seeds.first()["fraud_date"] == dt.date(2012, 12, 31)


def test_label_files(spark, tmp_path):
    df = spark.createDataFrame([("0000000007", "T", "Co", 12, dt.date(2010, 5, 1), 90.5)], "cik string, ticker string, company_name string, aaer_no int, fraud_date date, match_score double")
    sinks.write_labels(df, str(tmp_path / "labels"))
    assert [tuple(r) for r in masters.read_labels(spark, str(tmp_path / "labels")).select(df.columns).collect()] == [tuple(r) for r in df.collect()]
    (tmp_path / "firm.csv").write_text(" CIK ,fyear,P_AAER\n7,2001,1\n")
    firm = masters.read_firm_years(spark, [str(tmp_path / "absent.csv"), str(tmp_path / "firm.csv")])
    assert [tuple(r) for r in firm.collect()] == [("0000000007", 2001, 1)]


@pytest.mark.parametrize("text, expected", [
    ("on January 15, 2020 x", dt.date(2020, 1, 15)), ("on jan 5 2020", dt.date(2020, 1, 5)), ("x 1/15/2020", dt.date(2020, 1, 15)),
    ("x 1/15/68", dt.date(2068, 1, 15)), ("x 1/15/69", dt.date(1969, 1, 15)), ("x 2020-01-15", dt.date(2020, 1, 15)),
    ("page 12 2001 then 3/4/2002", dt.date(2002, 3, 4)), ("13/45/2020 then 2020-01-15", dt.date(2020, 1, 15)), ("none", None),
])
def test_release_dates(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string").select(*tx.release_hits(F.col("t"), "h_"))
    assert df.select(tx.release_date("h_")).first()[0] == expected


def test_release_parsing_and_fallback(spark):
    rows = [
        (1, "/a", "AAER-3001 January 5, 2010 In the Matter of Acme Corp., X", None),
        (2, "/b", "AAER No. 3001 January 6, 2010 In the Matter of Other, X", None),
        (3, "/c", "AAER-3002", "AAER-3002 2011-02-03 complaint against Beta; filed"),
        (4, "/d", "January 7, 2010 Respondent: Gamma Ltd., x", None), (5, "/e", "January 8, 2010 Respondent: Delta; x", None), (6, "/f", "nothing", None),
    ]
    df = spark.createDataFrame(rows, "entry_no int, url string, raw_text string, detail_text string")
    got = {r["entry_no"]: (r["aaer_no"], str(r["fraud_date"]), r["raw_name"]) for r in dataset.parse_releases(df).collect()}
    assert got == {1: (3001, "2010-01-05", "Acme Corp"), 3: (3002, "2011-02-03", "Beta"), 4: (None, "2010-01-07", "Gamma Ltd"), 5: (None, "2010-01-08", "Delta")}


def test_page_entries_and_text(spark):
    html = '<a href="/x/aaer-1.htm">One</a><a href="http://o/p">AAER two</a><a href="/q">no</a><tr><td>AAER-3000</td><td><a href="/z">d</a></td><td>n &amp; m</td></tr><script>var x="<b>";</script>'
    df = spark.createDataFrame([(1, "u", html)], "page_id int, url string, html string")
    got = {(r["kind"], r["url"], r["raw_text"]) for r in pg.index_entries(df).collect()}
    assert got == {("link", "https://www.sec.gov/x/aaer-1.htm", "One"), ("link", "http://o/p", "AAER two"), ("row", "https://www.sec.gov/z", "AAER-3000 d n & m")}
    assert pg.page_text(df).first()["text"] == "One AAER two no AAER-3000 d n & m"


@pytest.mark.parametrize("value, text", [(1.234e12, "$1.23T"), (-2.5e9, "-$2.50B"), (1.26e6, "$1.3M"), (1234.5, "$1,234"), (None, "N/A"), (0.0, "$0")])
def test_money(spark, value, text):
    assert spark.range(1).select(tx.money(F.lit(value).cast("double"))).first()[0] == text


@pytest.mark.parametrize("value, text", [(-0.0001, "-0.0%"), (0.12345, "12.3%"), (0.0625, "6.2%"), (None, "N/A")])
def test_percent(spark, value, text):
    assert spark.range(1).select(tx.percent(F.lit(value).cast("double"))).first()[0] == text


def lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_ratio_symmetric_and_exact():
    assert match.ratio("general motors", "general motor") == pytest.approx(200 * 13 / 27)
    for a, b in (("abc", "xaybzc"), ("x" * 80, "x" * 70 + "y"), ("", ""), ("é ü", "e ü")):
        assert match.ratio(a, b) == match.ratio(b, a)
        if a:
            assert match.lcs_length(a, b) == lcs(a, b)


@pytest.mark.parametrize("threshold", [65.0, 82.0])
def test_best_names_equal_brute_force(spark, threshold, monkeypatch):
    import random

    monkeypatch.setattr(match, "BLOCK", 7)  # force split groups
    rng = random.Random(11)
    words = ["alpha", "beta", "gamma", "delta", "omega", "energy", "steel", "bank", "x" * 40]
    names = {" ".join(sorted(rng.sample(words, rng.randint(1, 3)))) for _ in range(60)}

    def mutate(s):
        s = list(s)
        for _ in range(rng.randint(0, 3)):
            s[rng.randrange(len(s))] = rng.choice("abcdefgh ")
        return "".join(s).strip()

    wanted = {mutate(rng.choice(sorted(names))) for _ in range(40)} - {""}
    got = {r["name"]: (round(r["ratio"], 6), r["match"]) for r in match.best_names(
        spark.createDataFrame([(n,) for n in wanted], "name string"), spark.createDataFrame([(n,) for n in names], "name string"), threshold
    ).collect()}
    expected = {}
    for a in wanted:
        best = max(names, key=lambda b: (200 * lcs(a, b) / (len(a) + len(b)), [-ord(c) for c in b]))
        top = max(200 * lcs(a, b) / (len(a) + len(b)) for b in names)
        if top >= threshold:
            expected[a] = (round(top, 6), min(b for b in names if round(200 * lcs(a, b) / (len(a) + len(b)), 9) == round(top, 9)))
        assert best
    assert got == expected


def test_scored_pairs_do_not_grow_with_the_master(spark):
    import random

    rng = random.Random(5)
    syllables = [a + b for a in "bcdfghklmnprstvz" for b in "aeiou"]

    def name():
        return " ".join(sorted("".join(rng.choice(syllables) for _ in range(rng.randint(2, 5))) for _ in range(rng.randint(1, 3))))

    master = sorted({name() for _ in range(8000)})
    asked = sorted({x[:5] + "q" + x[6:] for x in rng.sample([m for m in master[:1000] if len(m) > 9], 150)})
    entries = spark.createDataFrame([(x,) for x in asked], "name string")
    per_entry = []
    for size in (2000, 8000):
        offered = spark.createDataFrame([(x,) for x in master[:1000] + master[1000:size]], "name string")
        out = match.searched_names(entries, offered, 82.0).collect()
        assert {r["name"] for r in out if r["ratio"] is not None} == set(asked)
        per_entry.append(sum(r["scored"] for r in out) / len(asked))
    assert per_entry[1] < 2 * per_entry[0] and per_entry[1] < 0.01 * len(master), per_entry


@pytest.mark.parametrize("t", [0.72, 0.82, 0.9])
def test_shared_runs_is_a_lower_bound(t):
    import random

    rng = random.Random(int(t * 100))
    for _ in range(400):
        a = "".join(rng.choice("abcd ") for _ in range(rng.randint(1, 24)))
        b = list(a)
        for _ in range(rng.randint(0, 5)):
            if b and rng.random() < 0.5:
                del b[rng.randrange(len(b))]
            else:
                b.insert(rng.randint(0, len(b)), rng.choice("abcd "))
        b = "".join(b)
        if not b or 2 * lcs(a, b) < t * (len(a) + len(b)):
            continue
        for size in (1, 2):
            common = len(set(match.numbered(a, size)) & set(match.numbered(b, size)))
            shortest = 0 if size == 1 else int(np.ceil(2 / (1.5 * t - 1)))
            if len(a) + len(b) >= shortest:
                assert common >= match.shared_runs(len(a), t, size, shortest) or size == 2 and len(a) + len(b) < shortest


def test_long_names_take_several_words(spark):
    import random

    rng = random.Random(9)
    for n in (63, 64, 65, 128, 190):
        a = "".join(rng.choice("abcdef") for _ in range(n))
        others = ["".join(rng.choice("abcdef") for _ in range(rng.randint(1, 200))) for _ in range(20)] + [a, a[::-1]]
        assert match._Names(others).common(a, np.arange(len(others))).tolist() == [lcs(a, b) for b in others]


def test_seed_resolution(spark):
    master = spark.createDataFrame([("0000000001", "ACI", "Albertsons Companies"), ("0000000002", "GE", "General Electric Co")], "cik string, ticker string, title string")
    filers = spark.createDataFrame([("0000000003", "ARCH COAL INC /DE/SIC:1220- COAL", ["10-K405"]), ("0000000004", "ARCH COAL INC", ["8-K"])], "cik string, title string, forms array<string>")
    seeds = masters.seed_table(spark, [("Arch Coal", 2015, "ACI"), ("General Electric", 2017, "ge"), ("GE General Electric", 2018, "GE"), ("Nowhere Ltd", 2010, None)], "bankruptcy_date", 6, 15)
    got = {r["cik"]: (r["ticker"], r["match_score"], r["bankruptcy_date"].year) for r in match.resolve_seeds(seeds, master, filers, "bankruptcy_date").collect()}
    assert got == {"0000000002": ("GE", 100.0, 2017), "0000000003": ("", 90.0, 2015)}


def test_name_normalisation(spark):
    df = spark.createDataFrame([("The ACME Holdings, Inc.",), ("Ünïted-Cö Co",), ("Inc.",)], "n string")
    assert [r[0] for r in df.select(tx.normalise_name(F.col("n"))).collect()] == ["the acme", "ünïted cö", ""]


def test_observations_are_compiled_and_companies_counted_once(spark):
    """The tags of a document become a column before they are filtered; the years of a company need no second pass over its facts."""
    body = '{"entityName": "A", "cik": 7, "facts": {"us-gaap": {"Assets": {"units": {"USD": [{"end": "%d-12-31", "val": 5, "form": "10-K", "filed": "%d-02-01"}]}}}}}'
    docs = fx.parse_facts(spark.createDataFrame([(body % (y, y + 1),) for y in (2001, 2002, 2002, 2003)] + [("{}",)], "json string"))
    obs = fx.observations(docs)
    assert sorted((r.concept, r.priority, r.tag, r.end) for r in obs.collect())[0] == ("total_assets", 0, "Assets", "2001-12-31") and obs.count() == 4
    held = [line for line in obs._jdf.queryExecution().optimizedPlan().toString().splitlines() if "filter(" in line]
    assert held and not any("total_assets" in line for line in held)
    master = spark.createDataFrame([("0000000007", "T", "A")], "cik string, ticker string, title string")
    raw = dataset.raw_table(docs, master, spark.createDataFrame([("t",)], "ticker string"), 3)
    assert raw.count() == 3 and dataset.raw_table(docs, master, None, 4).count() == 0
    assert raw._jdf.queryExecution().optimizedPlan().toString().count("from_json") <= 1


def test_names_one_character_off_are_joined(spark, monkeypatch):
    """Short names over few letters, where ties and better matches of other lengths abound, equal brute force; where one character
    tells every name, no bigram is looked at."""
    import random
    from itertools import product

    rng = random.Random(23)
    every = ["".join(x) for n in (1, 2, 3, 4, 5) for x in product("abé", repeat=n)]
    names, wanted = rng.sample(every, 90), rng.sample(every, 120)
    offered = spark.createDataFrame([(n,) for n in names], "name string")
    for threshold in (40.0, 82.0):
        found = {r["name"]: (round(r["ratio"], 9), r["match"]) for r in match.best_names(
            spark.createDataFrame([(n,) for n in wanted], "name string"), offered, threshold).collect()}
        expected = {}
        for a in wanted:
            top, best = min((-round(200 * lcs(a, b) / (len(a) + len(b)), 9), b) for b in names)
            if -top >= threshold:
                expected[a] = (-top, best)
        assert found == expected
    monkeypatch.setattr(match, "_ranked", None)
    master = [f"company {k:06d}" for k in range(300)]
    asked = {m[:3] + m[4:]: m for m in master[:100]} | {m[:5] + "x" + m[5:]: m for m in master[100:200]}
    out = match.best_names(
        spark.createDataFrame([(a,) for a in asked], "name string"), spark.createDataFrame([(m,) for m in master], "name string"), 82.0)
    assert {r["name"]: r["match"] for r in out.collect()} == asked
