from corpusloom.llm.cutoff import cut_texts, rest_of

SENTENCES = ["The licence shall be renewed before the end of the year", "No person shall moor a vessel in the harbour without a permit", "An appeal shall lie to the tribunal within thirty days of the notice"]


def test_rest_of():
    assert rest_of("some text ... ") == ("some text", False)
    assert rest_of("done.…") == ("done.", True)
    assert rest_of("exceeds Rs.") == ("exceeds Rs.", False)
    assert rest_of("see [Act, Section 3]") == ("see [Act, Section 3]", True)
    assert rest_of(" \n") == ("", False)
    for mark in ("[see more]", "(continued)", "<truncated>", "read more", "[cut off]"):
        assert rest_of(f"shall be ren {mark}") == ("shall be ren", False)
    assert rest_of("as it stood (as amended)")[0] == "as it stood (as amended)"


def corpus():
    rows = [(f"c{i}", "s", f"{SENTENCES[i % 3]}. {SENTENCES[(i + 1) % 3]}.") for i in range(60)]
    rows += [(f"y{i}", "s", "Within sixty days") for i in range(5)] + [(f"l{i}", "s", "You need:\n* the licence\n* the permit") for i in range(5)]
    cut = {"word": "The licence shall be ren", "words": "The licence shall be renewed before", "mark": "No person shall moor a vessel in…", "bracket": "The licence shall be renewed before the end of the year [Act, Sec", "spaces": "An appeal shall lie to the   "}
    whole = {"nostop": SENTENCES[0], "two": f"{SENTENCES[1]}. {SENTENCES[2]}", "full": "Anything at all ends here.", "cited": f"{SENTENCES[0]} [Act, Section 3]"}
    rows += [(k, "s", t) for k, t in {**cut, **whole}.items()]
    return rows + [("null", "s", None), ("empty", "s", ""), ("blank", None, " \n"), ("dots", "s", "...")], set(cut)


def test_cut_and_complete_texts(spark):
    rows, cut = corpus()
    d = spark.createDataFrame(rows + rows[-12:], "key string, source string, text string")
    assert {r.key for r in cut_texts(d).filter("cut").collect()} == cut


def test_empty_table(spark):
    d = spark.createDataFrame([], "key string, source string, text string, cut boolean, last string")
    assert cut_texts(d).count() == 0


def test_hot_values_give_the_same(spark):
    rows, cut = corpus()
    d = spark.createDataFrame(rows, "key string, source string, text string")
    assert {r.key for r in cut_texts(d, hot=2).filter("cut").collect()} == cut
