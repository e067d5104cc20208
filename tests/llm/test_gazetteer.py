import pytest
from plenarium.llm import gazetteer as G

NAMES = [("UKR", "Ukraine"), ("UKR", "Україна"), ("DEU", "Federal Republic of Germany"), ("DEU", "Germany"), ("DEU", "Deutschland"), ("SSD", "South Sudan"), ("SDN", "Sudan"), ("NER", "Niger"), ("NGA", "Nigeria"), ("ARE", "UAE"), ("ARE", "United Arab Emirates"), ("MLT", "Malta"), ("MLI", "Mali"), ("COD", "Democratic Republic of the Congo"), ("TUR", "Türkiye"), ("BGD", "Bangladesh")]
TRIE = G.Trie(NAMES, G.COUNTRY_WORDS)

CASES = {
    "Ukriane": "UKR", "UKRAINE": "UKR", "(Ukraine)": "UKR", "ukr": "UKR", "Govt of Ukraine": "UKR", "УКРАЇНА": "UKR", "Germany, Federal Republic of": "DEU",
    "Fed. Rep. of Germany": "DEU", "FederalRepublicofGermany": "DEU", "Federal_Republic_of_Germany": "DEU", "Deutschla": "DEU", "federal republic o germay": "DEU",
    "S. Sudan": "SSD", "South Su": "SSD", "Sudan [sic]": "SDN", "Niger": "NER", "Nigera": "NGA", "U.A.E.": "ARE", "DR Congo": "COD", "Dem. Rep. Congo": "COD", "Turkiye": "TUR",
    "Malta Street": "NONE", "Niger Delta": "NONE", "Varano": "NONE", "EU": "NONE", "?!": "NONE", "Banglad": "BGD", "from Malta": "MLT", "Mlata": "MLT",
}


@pytest.mark.parametrize("name,iso3", CASES.items())
def test_names(name, iso3):
    found = G.nearest(TRIE, name)
    assert (found[3] if found else "NONE") == iso3


def test_without_the_words_of_a_corpus():
    plain = G.Trie(NAMES)
    assert G.nearest(plain, "Ukriane")[3] == G.nearest(plain, "(Ukraine)")[3] == "UKR" and G.nearest(plain, "DR Congo")[3] == "COD"
    assert G.nearest(plain, "Govt of Ukraine") is None and G.nearest(plain, "Fed. Rep. of Germany") is None


def distance(a, b):
    """Restricted edit distance with transpositions."""
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_search_finds_all_within_reach():
    entries = sorted({(a.replace(" ", ""), i) for i, n in NAMES for a in G.aliases(n, G.COUNTRY_WORDS.short)})
    for word in ["ukriane", "germay", "sudan", "nigeri", "mlaat", "deutchlnd", "untedarabemirates", "maltaa", "malli", "xxxxxxx", "bagladesh"]:
        expected = {}
        for a, i in entries:
            if (d := distance(word, a)) <= G.reach(max(len(word), len(a))):
                expected[i] = min(expected.get(i, 99), d)
        got: dict[str, int] = {}
        for (i, _), (d, _) in TRIE.search(word).items():
            got[i] = min(got.get(i, 99), d)
        assert got == expected, word


def test_eleven_letters_of_fourteen():
    assert G.reach(13) == 2 and G.reach(14) == 3
    for word in ["olomonislnd", "solomonilan", "slmonislnds"]:
        assert len(word) == 11 and distance(word, "solomonislands") == 3
        assert G.Trie([("SLB", "Solomon Islands")]).search(word) == {("SLB", "Solomon Islands"): (3, -14)}


def test_rows(spark):
    ref = spark.createDataFrame(NAMES, "iso3 string, country_name string")
    rows = [(1, "Ukriane", "x"), (2, "Ukraine", "x"), (3, None, "x"), (4, "", "x"), (5, "Ukriane", "x"), (5, "Ukriane", "x"), (None, "Varano", "x"), (7, "Ukr​aine", "x"), (8, "Ｕkraime", "x"), (9, "z" * 50_000, "x")]
    df = spark.createDataFrame(rows, "fact_id long, entity string, iso3 string")
    got = sorted((r["fact_id"] or 0, r["iso3"]) for r in G.match_names(df, "fact_id", "entity", ref, "iso3", "country_name", "iso3").collect())
    assert got == [(0, "NONE"), (1, "UKR"), (5, "UKR"), (5, "UKR"), (8, "UKR"), (9, "NONE")]
    assert G.match_names(df.limit(0), "fact_id", "entity", ref, "iso3", "country_name", "iso3").count() == 0
    assert {r["iso3"] for r in G.match_names(df, "fact_id", "entity", ref.limit(0), "iso3", "country_name", "iso3").collect()} == {"NONE"}


def test_reference_in_blocks(spark, monkeypatch):
    """A reference of many blocks gives what one trie gives; so do few names at a time."""
    ref = spark.createDataFrame(NAMES, "iso3 string, country_name string").repartition(2)
    df = spark.createDataFrame(list(enumerate([*CASES, "Germany", "Mali"])), "fact_id long, entity string")
    whole = {r["fact_id"]: r["iso3"] for r in G.match_names(df, "fact_id", "entity", ref, "iso3", "country_name", "iso3", G.COUNTRY_WORDS).collect()}
    assert whole == {i: c for i, (x, c) in enumerate(CASES.items()) if x not in dict((n, c) for c, n in NAMES)}
    monkeypatch.setattr(G, "BLOCK", 3)
    monkeypatch.setattr(G, "NAMES", 5)
    assert {r["fact_id"]: r["iso3"] for r in G.match_names(df, "fact_id", "entity", ref, "iso3", "country_name", "iso3", G.COUNTRY_WORDS).collect()} == whole


def test_candidates(spark, monkeypatch):
    monkeypatch.setattr(G, "BLOCK", 5)
    ref = spark.createDataFrame([*NAMES, ("NER", "Niger")], "iso3 string, country_name string")
    df = spark.createDataFrame([("Nigera",), ("Nigera",), ("Niger",), ("Mlta",), (None,), ("",), ("Varano",)], "entity string")
    got = {tuple(r) for r in G.candidates(df, "entity", ref, "iso3", "country_name").collect()}
    assert got == {("Nigera", "NER", "Niger", 1), ("Nigera", "NGA", "Nigeria", 1), ("Mlta", "MLT", "Malta", 1)}
    assert G.candidates(df.limit(0), "entity", ref, "iso3", "country_name").count() == G.candidates(df, "entity", ref.limit(0), "iso3", "country_name").count() == 0
