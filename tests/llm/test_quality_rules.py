import random
import re
from collections import Counter

from holdnet.llm import quality_rules as q

SCHEMA = "doc_id long, text string, _w string, n_words int, kept int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    counts = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(5)}
    n = len(words)
    failed = n < 10 or 100 * len(covered) > 20 * n
    chars = sum(map(len, words))
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    dups = len(lines) - len(set(lines))
    upper = len(re.findall(r"[A-Z]", text))
    bad = (symbols * 100 > n * 10 or upper * 100 > len(text) * 50 or dups * 100 > len(lines) * 50 or chars < 2 * n or chars > 16 * n)
    return n, chars, symbols, dups, len(covered), failed, not (failed or bad)


def data():
    rng = random.Random(5)
    words = ["alpha", "Beta", "γδ", "x1", "naïve", "a", "日本", "word's", "#", "A|B", "\x1cq", "LOUD", "ééé"]
    seps = [" ", " ", " ", "\n", "\t", "  ", "\r\n", "\x0b", "\x85", "\xa0"]
    rows = [(k, "".join(rng.choice(words) + rng.choice(seps) for _ in range(rng.choice([0, 4, 12, 60, 200])))) for k in range(300)]
    for k in range(60):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([12, 40, 300]))]
        if k % 3 == 0:
            at = rng.randrange(len(base) - 6)
            base += base[at:at + rng.choice([4, 5, 6])]
        rows.append((1000 + k, ("\n" if k % 2 else " ").join(base)))
    rows += [(2000, None), (2001, ""), (2002, " \n\t "), (2003, "one two three four five " * 2), (2004, "a a a a a a a a a a"),
             (2005, "same line here\n" * 5 + "other words follow now ok then"), (2005, "z" * 40000), (None, "SHOUTING " * 30),
             (2006, " ".join(f"v{k}" for k in range(30000)))]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "x", 1, 0) for d, t in rows], SCHEMA).repartition(4)


def test_report_matches_brute_force(spark):
    rows = data()
    got = q.quality_report(frame(spark, rows)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    assert sorted((tuple(r[c] for c in names) for r in got), key=key) == sorted(((d, *brute(t)) for d, t in rows), key=key)


def test_filter_keeps_the_same_rows_in_any_rule_order(spark):
    rows = data()
    df = frame(spark, rows)
    want = sorted((d or 0, t) for d, t in rows if brute(t)[-1])
    for rules in (None, list(reversed(q.BASE_RULES + q.METHOD_RULES))):
        out = q.filter_quality(df, rules=rules)
        assert out.columns == df.columns
        assert sorted((r.doc_id or 0, r.text) for r in out.collect()) == want


def test_order_is_by_rejection_per_cost(spark):
    df = frame(spark, [(k, "few words" if k % 2 else "plenty of words " * 4) for k in range(50)]).select("text")
    rules = [q.Rule("never", lambda f: f.n_words() < 0), q.Rule("half", lambda f: f.n_words() < 10)]
    assert [r.name for r in q.order_rules(df, rules, q.TextFacts(df.text))] == ["half", "never"]


def test_empty_table(spark):
    none = frame(spark, [])
    assert q.quality_report(none).count() == 0 and q.filter_quality(none).count() == 0
