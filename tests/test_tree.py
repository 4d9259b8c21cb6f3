from pyspark.sql import functions as F

from florilege import schemas
from florilege.operators import tree
from florilege.sources import files

COLUMNS = [c.split(" ")[0] for c in schemas.PLACES.split(", ")]


def place(ident, name, code, country="", admin1="", admin2="", population="5000", alternates=""):
    cells = dict.fromkeys(COLUMNS, "") | {"geonameid": ident, "name": name, "asciiname": name, "feature_code": code, "country_code": country, "admin1": admin1, "admin2": admin2, "population": population, "alternatenames": alternates}
    return "\t".join(cells[c] for c in COLUMNS)


def build(spark, tmp_path, places, hierarchy, admin=()):
    (tmp_path / "p.tsv").write_text("\n".join(places) + "\n\n")
    (tmp_path / "h.tsv").write_text("".join(f"{p}\t{c}\tADM\n" for p, c in hierarchy))
    (tmp_path / "a.tsv").write_text("".join(f"{code}\tn\tn\t{i}\n" for code, i in admin))
    rows = files.places(spark, str(tmp_path / "p.tsv"))
    codes = files.admin_codes(spark, str(tmp_path / "a.tsv")) if admin else None
    nodes = tree.place_tree(rows, tree.parents(rows, files.hierarchy(spark, str(tmp_path / "h.tsv")), codes))
    return {r.node_id: (r.parent_id, r.level) for r in nodes.collect()}


EARTH = place(tree.EARTH, "Earth", "AREA")


def test_first_parent_missing_parent_and_removal(spark, tmp_path):
    places = [EARTH, place("1", "Asia", "CONT"), place("2", "Land", "PCLI", "LA"), place("4", "Town", "PPL", "LA"), place("5", "Hamlet", "PPL", population="999"), place("6", "Lost", "PPL"), place("7", "Island", "PCLI"), place("8", "Port", "PPL")]
    hierarchy = [(tree.EARTH, "1"), ("1", "2"), ("9", "2"), ("3", "4"), ("2", "3"), (tree.EARTH, "7"), ("7", "8"), ("5", "5")]
    got = build(spark, tmp_path, places, hierarchy)
    assert got == {tree.EARTH: (None, 0), "1": (tree.EARTH, 1), "2": ("1", 2), "4": ("2", 3)}


def test_admin_fallback(spark, tmp_path):
    places = [EARTH, place("1", "Asia", "CONT"), place("2", "Land", "PCLI"), place("3", "Town", "PPL", "LA", "01", "00"), place("4", "City", "PPL", "LA", "01", "77"), place("5", "Off", "ADM3", "LA", "01", "")]
    got = build(spark, tmp_path, places, [(tree.EARTH, "1"), ("1", "2")], [("LA.01", "2"), ("LA.01.77", "2")])
    assert got["3"] == ("2", 3) and got["4"] == ("2", 3) and "5" not in got


def test_cycles_go(spark):
    nodes = spark.createDataFrame([("r", None, "r"), ("a", "r", "a"), ("b", "c", "b"), ("c", "b", "c")], "node_id string, parent_id string, name string")
    assert {r.node_id: r.level for r in tree.levels(nodes, "r").collect()} == {"r": 0, "a": 1}
    assert {r.node_id: r.path for r in tree.paths(nodes).collect()} == {"r": ["r"], "a": ["r", "a"]}
    assert tree.paths(nodes).filter("node_id = 'a'").select(tree.printed(F.col("path")).alias("x")).first().x == "r\n  a"


def test_aliases(spark):
    rows = spark.createDataFrame([(["Germany"], ["German", "Thai", "Chinese", "Czech"])], "n array<string>, d array<string>")
    got = set(rows.select(tree.alias_sets(F.col("n"), F.col("d")).alias("x")).first().x)
    assert got == {"germany", "german", "germen", "thai", "thais", "chinese", "czech", "czechs"}


def test_alternates_round_trip(spark, tmp_path):
    (tmp_path / "alt.tsv").write_text("1\t10\ten\tBig\t1\t\tx\t0\t\t\n2\t10\tlink\thttp\t\t\t\t\t\t\n3\t10\ten\tHuge\t1\t\t\t\t\t\n4\t99\ten\tNo\t1\t\t\t\t\t\n")
    alternates = files.alternate_names(spark, str(tmp_path / "alt.tsv"))
    nodes = spark.createDataFrame([("10", "Large"), ("11", "Small")], "node_id string, name string")
    assert {r.node_id: r.short_name for r in tree.short_names(nodes, alternates).collect()} == {"10": "Big", "11": "Small"}
    assert {r.node_id: sorted(r.names) for r in tree.alternates_of(nodes, alternates).collect()} == {"10": ["Big", "Huge"]}
    files.write_alternate_names(alternates, str(tmp_path / "out"))
    again = files.alternate_names(spark, str(tmp_path / "out")).drop("line")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, alternates.drop("line").collect()))


def test_place_groups(spark, tmp_path):
    places = [EARTH, place("1", "Asia", "CONT"), place("2", "Japan", "PCLI", population="100", alternates="Nippon,"), place("3", "Japan", "PPL", population="2000")]
    (tmp_path / "p.tsv").write_text("\n".join(places))
    (tmp_path / "h.tsv").write_text(f"{tree.EARTH}\t1\tA\n1\t2\tA\n2\t3\tA\n")
    (tmp_path / "alt.tsv").write_text("1\t2\ten\tLand of Japan\t1\t\t\t\t\t\n")
    (tmp_path / "raw.json").write_text('{"Japanese": ["Nippon"], "Nipponer": ["japan"]}')
    (tmp_path / "done.json").write_text('{"3": ["Townsman"]}')
    read = lambda n: files.demonyms(spark, str(tmp_path / n))
    tables = (files.places(spark, str(tmp_path / "p.tsv")), files.hierarchy(spark, str(tmp_path / "h.tsv")))
    nodes, aliases = tree.place_groups(*tables, alternates=files.alternate_names(spark, str(tmp_path / "alt.tsv")), raw=read("raw.json"))
    assert {r.node_id: r.short_name for r in nodes.collect()}["2"] == "Land of Japan"
    own = lambda t, n: {r.alias for r in t.filter(f"node_id = '{n}'").collect()}
    assert own(aliases, "2") == {"japan", "nippon", "land of japan", "japanese"}
    assert own(aliases, "3") == {"japan", "nipponer", "nipponers"}  # the larger of two places of one name
    assert own(tree.place_groups(*tables, processed=read("done.json"))[1], "3") == {"japan", "townsman", "townsmen"}
