"""Cases of decontamination that hang on what stands in the slots of an item."""

from orbitlake.llm import decontamination

ITEM = "A train leaves at 7 with 12 boxes for Maria and drives 40 km to the old harbour, where Maria unloads 12 boxes"


def found(spark, docs, items):
    rows = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    hits = decontamination.contaminated(rows, bench).collect()
    kept = decontamination.decontaminate(rows, bench).collect()
    assert {r["doc_id"] for r in kept} == set(range(len(docs))) - {r["doc_id"] for r in hits}
    return {(r["doc_id"], r["item_id"]): (r["covered"], r["refilled"]) for r in hits}


def test_a_clash_voids_its_own_windows_only(spark):
    verbatim = ITEM.replace("Maria unloads 12", "Peter unloads 19")
    refilled = ITEM.replace("12", "15").replace("Maria", "Peter").replace("40", "52").replace("unloads 15", "unloads 19")
    long = "Give 12 pens to the boy near door 12 and then 12 caps to the girl near gate 12 or to the man"
    scattered = long.replace("pens to the boy near door 12", "pens to the boy near door 13").replace("then 12", "then 14").replace("gate 12", "gate 15")
    hits = found(spark, [f"before {verbatim} after", f"before {refilled} after", scattered], [ITEM, long])
    assert hits == {(0, 0): (19, False), (1, 0): (21, True)}


def test_items_without_literal_windows(spark):
    sums = "12 + 30 = 42 km, 15 + 18 = 33 km, 70 - 21 = 49 kg and 9 x 9 = 81"
    people = "present were Anna Berg, Carl Dahl, Emma Falk, Gus Holm, Ida Jung, Kai Lund and Mia Nord"
    short = ["Who wrote Faust?", "Zwölf"]
    docs = [f"see {sums} there", f"so {people} too", people.upper(), "then who wrote faust and why", "who wrote the Faust", "zwölf", sums.replace("42", "43").replace("33", "34").replace("49", "50").replace("81", "82")]
    hits = found(spark, docs, [sums, people, *short])
    assert set(hits) == {(0, 0), (1, 1), (2, 1), (3, 2), (5, 3)}
    assert not any(refilled for _, refilled in hits.values()) and hits[3, 2] == (3, False) and hits[5, 3] == (1, False)
    assert hits[0, 0][0] == 17 and hits[2, 1][0] == 17
