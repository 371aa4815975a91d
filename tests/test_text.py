from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.operators import corpus


def column(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_reasons_in_order(spark):
    texts = ["", "  \n", " = Title = ", "== A ==\n", "x" * 49, "x" * 50, " " + "x" * 50 + " ", None, "= no end"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = [r["reason"] for r in corpus.clean(df).orderBy("i").collect()]
    assert got == ["empty", "empty", "heading", "heading", "short", None, None, "empty", "short"]


def test_names(spark):
    got = column(spark, ["7", "triple_12_x", "triplet_003", "foo", "", "1234"], T.canonical_triplet)
    assert got == ["triplet_007", "triplet_012", "triplet_003", "foo", "", "triplet_1234"]


def test_selection_keeps_first_mention(spark):
    assert column(spark, ["3, 1  3\n2,"], T.selection) == [["3", "1", "2"]]


def test_questions(spark):
    assert column(spark, ["a  b.", "a?", "a!!.", ""], T.as_question) == ["a b?", "a?", "a?", ""]


def test_last_marker_by_priority(spark):
    got = column(spark, ["Final: a", "x assistantfinal b final: c", "final answer d final answer e", "none"], T.after_last_marker)
    assert got == ["a", "b final: c", "e", "none"]


def test_marker_keeps_offsets(spark):
    assert column(spark, ["final: İİ tail", "İİ Final Answer:= x", "ΑΣ FINAL: y", "final:"], T.after_last_marker) == ["İİ tail", "x", "y", ""]
    assert [T.marked(t) for t in ("final: İİ tail", "İİ Final Answer:= x", "final:", "none")] == ["İİ tail", "x", "", ""]


def test_first_object():
    assert T.json_object('x {bad {"a": "}\\""} y') == {"a": '}"'}
    assert T.json_object("{[1]}") is None and T.json_object("") is None
    assert T.json_object('[{"a": 1}]') == {"a": 1}


CASES = [
    ('{"question": "Who?", "answer": "Me."}', "Who?", "Me."),
    ('```json\n{"question": "Where was it.", "answer": "Here  now"}\n```', "Where was it?", "Here now"),
    ('thinking {not json} assistantfinal {"question": "Why", "answer": "A {brace} \\"quoted\\""} end', "Why?", 'A {brace} "quoted"'),
    ('{"question": "Cut?", "answer": "no end of it', "Cut?", "no end of it"),
    ('{"question": "Cut?", "answer": "no brace"', "Cut?", "no brace"),
    ('{"question": "Cut?", "answer": "ends"}"} \n', "Cut?", "ends"),
    ('draft {"question": "Draft?", "answer": "wrong"} assistantfinal {"question": "Real?", "answer": "right"}', "Real?", "right"),
    ('draft {"question": "Draft?", "answer": "right"} assistantfinal nothing', "Draft?", "right"),
    ('{"question": "Draft?", "answer": "a"} final: {"question": "Real", "answer": "cut of', "Draft?", "a"),
    ('x "question": "Draft?", "answer": "a" final: {"question": "Real", "answer": "cut of', "Real?", "cut of"),
    ('{"question": "caf\\u00e9\\/?", "answer": "a\\r\\nb caf\\u00e9', "café/?", "a b café"),
    ('{"question": "raw\nline \\"q\\"", "answer": "bad \\x escape\\\\ \\/"}', 'raw line "q"?', "bad \\x escape\\ \\/"),
    ('{"question": 1, "answer": "a"}', None, None),
    ("nothing here", None, None),
    ('Final: {"question": "a", "answer": ""}', None, None),
    ('{"question": "open', None, None),
    ("", None, None),
    (None, None, None),
]


def test_parse_cascade(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, raw string")
    q, a, why = T.parse_answer(F.col("raw"))
    for r in df.select("i", q.alias("q"), a.alias("a"), why.alias("why")).collect():
        want = CASES[r["i"]][1:]
        assert ((r["q"], r["a"]), r["why"]) == (want, None if want[0] else "unparsable"), CASES[r["i"]]


def test_stop_words_in_order(spark):
    assert column(spark, ["a\nb. c", "x. y\nz", ""], lambda c: T.truncate_at(c, ["\n", ". "])) == ["a", "x", ""]


def test_splits_are_disjoint_and_small_clusters_skipped(spark):
    df = spark.createDataFrame([(i, 0 if i < 9 else 1 if i < 17 else -1) for i in range(40)], "text_id long, cluster_label int")
    t = corpus.triplet_splits(df, "cluster_label", "text_id", (3, 3, 3), 2).collect()
    assert {r["triplet"] for r in t} == {"triplet_001", "triplet_002"} and {r["cluster_label"] for r in t} == {0}
    assert len({(r["triplet"], r["text_id"]) for r in t}) == 18
    skips = corpus.triplet_skips(df, "cluster_label", (3, 3, 3), 2).collect()
    assert [(r["cluster_label"], r["cluster_size"], r["skipped_triplets"]) for r in skips] == [(1, 8, 2)]


def test_keyword_limit_falls_until_a_term_reaches_it(spark):
    df = spark.createDataFrame([(0, 1, "apple apple pear"), (0, 2, "apple the"), (1, 3, "plum")], "g int, id int, text string")
    got = [(r["g"], r["rank"], r["term"], r["total"]) for r in corpus.top_keywords(df, "g", "id").orderBy("g", "rank").collect()]
    assert got == [(0, 1, "apple", 3), (1, 1, "plum", 1)]
