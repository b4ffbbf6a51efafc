import random

from corpusloom.llm.reading import reading_levels

POOLS = [
    "the boy saw the fish and ran home|my aunt has a red boat by the sea|we all sat down to eat the rice|the goat took the bag from the girl",
    "please fill in the form and send it to the office|you can pay the fee at the counter|keep this page with your papers for later|ask the clerk for a receipt when you pay the fee",
    "the ministry said that the number of complaints increased last year|officials told the committee that further changes were expected|critics argued that the costs had not been published|the department expects to publish the report",
    "notwithstanding the generality of the powers conferred by the section|the impugned determination was predicated upon an erroneous apprehension|the proviso qualifies the antecedent entitlement of the lessee|inasmuch as the covenant is unenforceable against successors in title",
]


def text(rnd, band, plain=False):
    s = [rnd.choice(POOLS[band - 1].split("|")) for _ in range(9)] + [rnd.choice(POOLS[max(0, band - 2)].split("|"))]
    rnd.shuffle(s)
    return " ".join(s).upper() if plain else ". ".join(x.capitalize() for x in s) + "."


def test_held_out_accuracy_and_cases(spark):
    rnd = random.Random(5)
    docs = [(i, text(rnd, i % 4 + 1), "zz", 9) for i in range(160)] + [(1000 + i, text(rnd, i % 4 + 1, True), None, 9) for i in range(40)]
    docs += [(2000, None, "en", 9), (2001, "", "en", 9), (2002, "Too short to say.", "en", 9), (2003, "Nul ne peut exploiter un étal sans l'accord écrit du service. " * 5, "en", 9)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, band int")
    labels = spark.createDataFrame([(i, f"r{k}", i % 4 + 1) for i in range(80) for k in (1, 2)] + [(0, "r1", 1), (1, "r9", 99), (5000, "r1", 2)], "doc_id bigint, rater_id string, band int")
    got = {r.doc_id: r for r in reading_levels(d, labels).collect()}
    assert set(got) == {i for i, *_ in docs if i < 2000}
    test = [i for i in got if i >= 80]
    assert sum(got[i].band == i % 4 + 1 for i in test) / len(test) >= 0.9
    assert all(abs(r.p1 + r.p2 + r.p3 + r.p4 - 1) < 1e-4 for r in got.values())


def test_without_labels_or_documents(spark):
    d = spark.createDataFrame([(1, "the boy saw the fish and ran to the sea " * 6)], "doc_id bigint, text string")
    labels = spark.createDataFrame([], "doc_id bigint, rater_id string, band int")
    assert [r.band for r in reading_levels(d, labels).collect()] == [1]
    assert reading_levels(d.limit(0), labels).count() == 0
