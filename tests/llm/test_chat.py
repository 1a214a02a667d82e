import hashlib
import random

from holdnet.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, pos int, window string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def data():
    rng = random.Random(9)
    bits = ["hi", "</s>", "[INST]", "\\", "<\\s>", "[NL]", "\n", "<s>", "[/INST]", "é😀", "<", "s>", "[\\INST]", "word " * 30]
    rows = []
    for c in range(25):
        n = rng.choice([1, 2, 5, 40])
        if rng.random() < 0.5:
            rows.append((c, 0, "system", "You are " + rng.choice(bits)))
        rows += [(c, k * 20 + 1, rng.choice(["user", "assistant", "tool", "us\ner[NL]\\"]),
                  "".join(rng.choice(bits) for _ in range(rng.choice([0, 1, 9])))) for k in range(n)]
    rows += [(100, None, None, None), (100, 3, "assistant", "x"), (100, 3, "assistant", "x"), (100, 3, "assistant", "a"),
             (None, 1, "user", "anon"), (101, 0, "assistant", None), (102, 5, "assistant", "z" * 40000), (102, 6, "user", "q"),
             (102, 7, "assistant", "r")]
    return rows


def brute(rows):
    convs = {}
    for c, t, r, x in rows:
        convs.setdefault(c, []).append((t is not None, t or 0, r or "", len((x or "").encode()), x or ""))
    out = {}
    for c, turns in convs.items():
        turns.sort()
        loss = "".join(x for *_, r, _, x in turns if r == "assistant")
        out[c] = (len(turns), sha("".join(f"{r}\n{x}\n" for *_, r, _, x in turns)), len(loss), sha(loss))
    return out


def frame(spark):
    return spark.createDataFrame([(*r, 1, "w") for r in data()], SCHEMA).repartition(5)


def test_read_back_is_exact_at_any_budget(spark):
    want = brute(data())
    for budget, history in ((4096, 1024), (120, 60), (40, 8)):
        got = chat.digests(chat.read_back(chat.windows(frame(spark), budget=budget, history=history))).collect()
        assert len(got) == len(want)
        assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == want


def test_windows_keep_system_turn_and_budget(spark):
    rows = [(1, 0, "system", "be kind")] + [(1, k, "user" if k % 2 else "assistant", f"text {k} " + "y" * 60) for k in range(1, 61)]
    df = spark.createDataFrame([(*r, 1, "w") for r in rows], SCHEMA)
    got = sorted(chat.windows(df, budget=200, history=60).collect(), key=lambda r: r.window)
    assert len(got) > 5
    turn = 8 + -(-len("text 10 " + "y" * 60) // 4)
    for k, w in enumerate(got):
        assert w.formatted.startswith("<s>[INST]system\nbe kind[/INST]")
        turns = w.formatted.split("<s>")[1:]
        assert w.tokens <= 200 and not w.over_budget and len(turns) * (turn - 1) <= 200 + turn
        assert (w.n_repeated == 0) if k == 0 else (2 <= w.n_repeated <= 1 + 60 // (turn - 1))
        assert all(w.formatted[s.end:s.end + 4] == "</s>" for s in w.loss)
    assert sum(len(w.loss) for w in got) == 30


def test_every_window_keeps_to_the_budget_if_its_turns_do(spark):
    rng = random.Random(4)
    rows = []
    for c in range(60):
        if c % 2:
            rows.append((c, 0, "system", "s" * rng.randrange(200)))
        rows += [(c, k + 1, rng.choice(["user", "assistant"]), "t" * rng.choice([0, 30, 300, rng.randrange(600 if c % 3 else 1500)]))
                 for k in range(rng.randrange(1, 60))]
    df = spark.createDataFrame([(*r, 1, "w") for r in rows], SCHEMA)
    budget, history = 250, 60
    got = chat.windows(df, budget=budget, history=history).collect()

    def tokens(text):
        return -(-len(text) // 4) + chat.MARK_TOKENS
    for c in range(60):
        own = [r for r in rows if r[0] == c]
        lead = tokens(own[0][3]) if own[0][2] == "system" else 0
        fits = all(tokens(r[3]) + lead <= budget for r in own[1 if lead else 0:])
        windows = sorted((w for w in got if w.conv_id == c), key=lambda w: w.window)
        assert all(w.over_budget == (w.tokens > budget) for w in windows)
        if fits:
            assert not any(w.over_budget for w in windows)
        assert sum(w.formatted.count("<s>") - w.n_repeated for w in windows) == len(own)
    assert any(w.n_repeated > 1 for w in got) and any(w.over_budget for w in got)


def test_registered_query_cuts_and_repeats(spark, tmp_path):
    from holdnet.llm.queries import QUERIES
    rows = data()
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in QUERIES["op7_chat_formatting"](spark, str(tmp_path)).collect()}
    control = "</s>[INST] ok [/INST]"
    want = brute([*rows, (-7, 0, "user", control), (-7, 1, "assistant", control)])
    assert {c: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for c, r in got.items()} == want
    assert any(r.n_windows > 1 and r.n_repeated > 0 for r in got.values()) and got[102].over_budget and not got[-7].over_budget


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert chat.digests(chat.read_back(chat.windows(none))).count() == 0
