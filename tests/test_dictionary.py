from tidemark.operators import detect

TERMS = "surface string, entity_id string, canonical string, code string, source string"


def test_dictionary_by_row(spark):
    """Rows of one id are texts of their own; surfaces within longer ones, begun but not ended, and odd letters."""
    t = [("1", "Iron deficiency, anaemia of iron; iron"), ("1", "é IRON-deficiency anaemia"), ("2", "deficiency iron def"), ("2", None)]
    terms = [(s, "phi::medical_condition", s.upper(), "c", "t") for s in ("iron deficiency", "iron deficiency anaemia", "iron deficiency anaemia of the old", "iron")]
    texts = spark.createDataFrame([(i, None, None, x) for i, x in t], "source_id string, row long, col string, text string")
    got = {(r.source_id, r.start, r.end, r.text, r.canonical, r.before, r.after) for r in detect.dictionary(texts, spark.createDataFrame(terms, TERMS), 6).collect()}
    one, two = t[0][1], t[1][1]
    assert got == {
        ("1", 0, 24, one[:24], "IRON DEFICIENCY ANAEMIA", "", one[24:]),
        ("1", 28, 32, "iron", "IRON", one[:28], one[32:]),
        ("1", 34, 38, "iron", "IRON", one[:34], ""),
        ("1", 2, 25, two[2:], "IRON DEFICIENCY ANAEMIA", two[:2], ""),
        ("2", 11, 15, "iron", "IRON", "deficiency ", " def"),
    }
    assert detect.dictionary(texts, spark.createDataFrame([], TERMS)).count() == 0
