"""Chat windows: exact round trips, budgets, masks, odd rows."""

import hashlib
import random
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from rolebook.llm import bpe
from rolebook.llm import chat as C
from rolebook.llm.queries import QUERIES, public_ranks

PIECES = ["</s>", "<s>", "[INST]", "[/INST]", "\\", "\\\\", "<", "[", "/", "ok", " ", "\n", "é", "s>", "INST]"]
TEXT = st.lists(st.sampled_from(PIECES), max_size=10).map("".join)


@settings(max_examples=2000, deadline=None)
@given(TEXT)
def test_escape(text):
    assert C.unescape(C.escape(text)) == text


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "[INST]\\"]), TEXT), max_size=8))
def test_round_trip(turns):
    w = C.Windows()
    done = [x for t in turns if (x := w.add(*t))] + [x for x in [w.close()] if x]
    assert [t for x in done for t in C.parse(x["text"])[x["repeated"] :]] == turns
    loss = [C.unescape(x["text"][t["start"] : t["end"]]) for x in done for t in x["targets"]]
    assert loss == [t for r, t in turns if r == "assistant"]


def test_windows(monkeypatch):
    monkeypatch.setattr(C, "BUDGET", 60)
    monkeypatch.setattr(C, "HISTORY_TOKENS", 30)
    rng = random.Random(4)
    for _ in range(200):
        turns = [("system", "be kind " * rng.randint(1, 6))] * rng.randint(0, 1)
        turns += [(rng.choice(["user", "assistant"]), "word " * rng.choice([0, 3, 8, 20, 90])) for _ in range(rng.randint(0, 12))]
        w = C.Windows()
        done = [x for t in turns if (x := w.add(*t))] + [x for x in [w.close()] if x]
        for k, x in enumerate(done):
            got = C.parse(x["text"])
            size = sum(C.tokens(*t) for t in got)
            assert size <= 60 or len(got) - x["repeated"] == 1 and x["repeated"] <= (turns[0][0] == "system") or k == 0 and len(got) == 1
            if k and turns[0][0] == "system":
                assert got[0] == turns[0]
            assert x["repeated"] <= C.HISTORY_TURNS + 1
        assert [t for x in done for t in C.parse(x["text"])[x["repeated"] :]] == turns


def plain(rows):
    by = defaultdict(list)
    for c, turn, role, text in rows:
        by[c].append((turn is not None, turn or 0, role or "", text or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    out = {}
    for c, t in by.items():
        t.sort()
        loss = "".join(x[3] for x in t if x[2] == "assistant")
        out[c] = (len(t), sha("".join(f"{x[2]}\n{x[3]}\n" for x in t)), len(loss), sha(loss))
    return out


def test_query(spark, tmp_path):
    rng = random.Random(6)
    rows = [(c, k, rng.choice(["user", "assistant", "system"]), "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 200)))) for c in range(60) for k in range(rng.randint(1, 8))]
    rows += [(900, 0, None, None), (900, 1, "assistant", None), (901, None, "user", "x"), (901, None, "user", "x"), (901, 0, "assistant", "b"), (None, 0, "user", "q"), (902, 0, "assistant", "long text " * 40_000)]
    rows += [(903, k, "assistant" if k % 2 else "user", f"turn {k}") for k in range(3000)]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "conv_id long, turn long, role string, text string, window int, targets string")
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: tuple(r)[1:5] for r in QUERIES["op9_chat"](spark, str(tmp_path)).collect()}
    said = "</s>[INST] ok [/INST]"
    assert got == plain([*rows, (-7, 0, "user", said), (-7, 1, "assistant", said)])
    assert C.read_back(C.windows(df.limit(0))).collect() == []
    for r in C.windows(df).where("conv_id = 903").collect():
        assert len(C.parse(r.text)) <= 64 and len(r.targets) == sum(x == "assistant" for x, _ in C.parse(r.text)[r.repeated :])


def test_budget_in_ids(spark):
    """With ``sized`` a window's ids, marks and escapes among them, are what the budget bounds."""
    ranks, pattern = public_ranks()
    codec = bpe.Codec(bpe.read_ranks(ranks), pattern)
    rng = random.Random(8)
    rows = [(c, k, ("user", "assistant")[k % 2], "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 60)))) for c in range(20) for k in range(20)]
    rows += [(50, None, None, None), (50, 1, "assistant", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    sized = C.sized(df, ranks, pattern)
    assert all(r["size"] == len(codec.encode([C.formatted(r.role or "", r.text or "")])[0]) for r in sized.collect())
    made = C.windows(sized).collect()
    for r in made:
        turns = C.parse(r.text)
        ids = sum(len(codec.encode([C.formatted(*t)])[0]) for t in turns)
        assert ids <= C.BUDGET or len(turns) - r.repeated == 1
    assert C.sized(df.limit(0), ranks, pattern).collect() == []


def test_system_turn_in_every_window(spark):
    long = [("system", "rule " * 250), ("user", "a b"), ("assistant", "c"), ("user", "word " * 300), ("assistant", "d " * 20)]
    tight = [("system", "be kind"), ("user", "word " * 250), ("assistant", "word " * 250), ("user", "x"), ("assistant", "word " * 400), ("user", "y")]
    rows = [(c, k, *t) for c, turns in enumerate([long, tight]) for k, t in enumerate(turns)]
    got = defaultdict(list)
    for r in C.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("conv_id", "window").collect():
        got[r.conv_id].append(r)
    for c, turns in enumerate([long, tight]):
        assert len(got[c]) > 2
        assert [t for r in got[c] for t in C.parse(r.text)[r.repeated :]] == turns
        for k, r in enumerate(got[c]):
            said = C.parse(r.text)
            assert said[0] == turns[0] and (k == 0 or r.repeated >= 1)
            # over the budget: one turn and the system turn, without history
            assert sum(C.tokens(*t) for t in said) <= C.BUDGET or len(said) == 2
            # what is repeated is masked
            assert len(r.targets) == sum(x == "assistant" for x, _ in said[r.repeated :])
