import pytest

from brindle.llm import names

DDL = "id string, name string, variants array<string>, exclusions array<string>, entity string, core string"


@pytest.mark.parametrize("name,want", [
    ("Coffee Roasters Muuklaklol Burul Sp. z o.o.", ("burul muuklaklol", "coffee", "", "zoo")), ("burul-muklaklol.example", ("burul muklaklol", "", "", "")), ("BMC", None), (" ", None), (None, None), ("Gredrik1on, Dripes Pets INC", ("dripes gredriklon", "pet", "", "inc")),
    ("Trdemi Naoa Lola", ("naoa trdemi", "", "dolores", "")), ("LoforDritols sp. zoo", ("dritols lofor", "", "", "zoo")),
])
def test_parse(name, want):
    p = names.parse(name)
    assert (p and (p["core"], p["trade"], p["given"], p["legal"])) == want


def test_collision_curve():
    b = names.bands_for()
    assert 1 - (1 - names.LEAST_SIMILARITY**names.ROWS) ** b >= names.RECALL > 1 - (1 - names.LEAST_SIMILARITY**names.ROWS) ** (b - 1)


def test_distance():
    assert names.distance("muklaklol", "mukalklol") == 1 and names.distance("", "ab") == 2 and names.core_similarity("naki hekemon", "hekemon", "", "dn") > 0.8 and names.core_similarity("burul muklaklol", "kahegri sado") == 0


ROWS = [
    ("1", "Burul Muklaklol Coffee Roasters Sp. z o.o.", ["BMC"], []), ("2", "Muclaklol Burul Coffee", [], None), ("3", "Burul Muklaklol Solar Systems", None, ["Burul Muklaklol Coffee Roasters"]), ("4", "Dolores Naki Hekemon", [""], []), ("5", "D. N. Hekeomn", ["Lola\xa0Naki Hekemon"], []),
    ("6", "Wilhelm Naki Hekemon", [], []), ("7", None, None, None), ("8", "Sado Khaegri Logistics", [], []), ("1", "Burul Muklaklol Coffee Roasters Sp. z o.o.", ["BMC"], []), ("9", "Burul Muklakl0l", [], ["Burul Muklaklol Solar Systems"]),
]


def test_links(spark):
    df = spark.createDataFrame([(*r, "x", "y") for r in ROWS], DDL)
    got = {(r.id_a, r.id_b) for r in names.found(df).collect()}
    assert got == {("1", "2"), ("1", "9"), ("2", "9"), ("4", "5")}


def test_empty(spark):
    assert names.found(spark.createDataFrame([], DDL)).count() == 0


def slips(w):
    """Words one slip away."""
    return {w[:i] + "x" + w[i + 1 :] for i in range(len(w))} | {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + "x" + w[i:] for i in range(len(w) + 1)} | {w[:i] + w[i + 1] + w[i] + w[i + 2 :] for i in range(len(w) - 1)}


def test_blocking_meets_all_accepted_cores(spark):
    words = ["burul", "hekemo", "muklakl", "gredriklonaf", "trdeminaoaliperkuswemto", "sadokahegrinloforditrolsmanu"]
    cores = {x for w in words for x in slips(w)} | {f"kolm {x}" for x in slips("berg")} | {"naki hekemon", "hekemonnaki", "nakihekemon", "lofo nabi", "lofa kumik"}
    rows = [(c, "kn" if c.startswith("lof") else "") for c in sorted(cores)]
    want = {(a, b) for a, x in rows for b, y in rows if a < b and names.core_similarity(a, b, x, y) >= names.CORE_SIMILARITY}
    df = spark.createDataFrame(rows, "core string, initials string")
    assert len(want) > 1000 and ("lofa kumik", "lofo nabi") in want
    assert want <= {tuple(r) for r in names.pairs_by_terms(df).distinct().collect()} and want <= {tuple(r) for r in names.core_pairs(df).collect()}


def test_typo_of_a_short_family_name(spark):
    rows = [(str(i), n, None, None, "x", "y") for i, n in enumerate(x for w in ("Burul", "Gremko", "Wistal", "Podkun") for x in (f"{w} Coffee Roasters", f"{w[:2]}{w[3]}{w[2]}{w[4:]} Coffee Roasters"))]
    got = {(r.id_a, r.id_b) for r in names.found(spark.createDataFrame(rows, DDL)).collect()}
    assert got == {("0", "1"), ("2", "3"), ("4", "5"), ("6", "7")}
