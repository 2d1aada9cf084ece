import re
from pathlib import Path

from tidemark.functions.needed import needed, sieve
from tidemark.operators import detect
from tidemark.plans.rules import catalogue, only


def test_needed():
    assert needed(r"(?i)\b(?:Jan|Feb)\.?\s+\d{1,2}\b") == (True, frozenset({"jan", "feb"}))
    assert needed(r"@|[\[(]at[\])]")[1] == frozenset({"@", "[at]", "[at)", "(at]", "(at)"})
    assert needed(r"(?:\d+)?x*") == (False, None) and needed(r"a?b|[^c]") == (False, None) and needed(r"(?:ab)+|cd\d")[0] is False
    assert needed(r"(?<=id )(\d)\1")[0] and needed(r"[0-9a]")[0] is False


def test_sieve_lets_every_match_through():
    """Of each pattern's own matches, in any case and with letters and digits that Unicode holds equal."""
    patterns = [p for r in catalogue() for p in r.patterns]
    may = sieve(patterns)
    lines = [x for line in Path(__file__).with_name("test_catalogue.py").read_text().split("\n") for x in line.split(" :: ")]
    arabic = str.maketrans("0123456789", "٠١٢٣٤٥٦٧٨٩")
    n = 0
    for x in lines:
        for t in {x, x.upper(), x.lower(), x.replace("s", "ſ"), x.replace("i", "ı"), x.replace("i", "İ"), x.replace("k", "K"), x.translate(arabic)}:
            for p, ok in zip(patterns, may(t)):
                if re.search(p, t):
                    n += 1
                    assert ok, (p, t)
    assert n > 500
    assert sum(may("no such words here")) < 20


def test_few_rules_run_in_batches(spark):
    t = detect.documents(spark.createDataFrame([(1, "mail a.b@example.org"), (2, None)], "doc_id long, text string"))
    found = detect.scan(t, only("email_address"))
    assert "MapInArrow" in found._jdf.queryExecution().toString() and [r.text for r in found.collect()] == ["a.b@example.org"]
