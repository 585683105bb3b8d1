"""Documents read in pieces against reading them as a whole."""

import json
import random

import pytest

from rolebook.sources import feeds, large, tables


def value(rng, depth=0):
    kind = rng.random()
    if kind < 0.35 or depth > 3:
        return "".join(rng.choice('ab,"\\{}[]:é日\n\t ') for _ in range(rng.randint(0, 9)))
    if kind < 0.5:
        return rng.choice([None, True, 1, -2.5e3])
    if kind < 0.75:
        return [value(rng, depth + 1) for _ in range(rng.randint(0, 4))]
    return {f"k{i},{rng.randrange(9)}": value(rng, depth + 1) for i in range(rng.randint(0, 4))}


def read(spark, path, part=None):
    entries, issues = large.entries_of(spark, str(path), part)
    out = {}
    for r in entries.orderBy("file", "entry_no").collect():
        out.setdefault(r.file.rsplit("/", 1)[1], []).append(r.text)
    return out, {r.file.rsplit("/", 1)[1]: r.error for r in issues.collect()}


@pytest.fixture(params=[61, 700, 1 << 20])
def small_splits(spark, request):
    """Cuts inside strings, keys, numbers and escapes."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", request.param)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_like_whole(spark, tmp_path, small_splits):
    rng = random.Random(4)
    docs = {f"a{i}.json": [value(rng) for _ in range(rng.randint(0, 25))] for i in range(4)}
    docs |= {f"o{i}.json": {f"key {j} ,{{": value(rng) for j in range(rng.randint(1, 25))} for i in range(4)}
    for name, doc in docs.items():
        (tmp_path / name).write_text(json.dumps(doc, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1])))
    got, issues = read(spark, tmp_path)
    assert issues == {}
    for name, doc in docs.items():
        texts = got.get(name, [])
        if isinstance(doc, list):
            assert [json.loads(t) for t in texts] == doc
        else:
            assert {k: v for t in texts for k, v in json.loads("{" + t + "}").items()} == doc and len(texts) == len(doc)


def test_part_of_a_document(spark, tmp_path, small_splits):
    rng = random.Random(5)
    seen = {f"k{i}": {"title": value(rng), "n": i} for i in range(40)}
    other = {"seen": 1, "list": [1, [2], {"seen": {}}]}
    files = {
        "s.json": {"version": 1, "note": "seen", "other": other, "seen": seen, "tail": {"x": [1, 2]}},
        "l.json": {"jobs": [], "seen": [1, {"a": ","}, "x"]},
        "none.json": {"jobs": [1, 2]},
        "flat.json": {"seen": "text"},
    }
    for name, doc in files.items():
        (tmp_path / name).write_text(json.dumps(doc))
    (tmp_path / "broken.json").write_text('{"seen": {"a": 1, "b": "x}')
    (tmp_path / "open.json").write_text('{"seen": {"a": 1}')
    got, issues = read(spark, tmp_path, "seen")
    assert {k: v for t in got["s.json"] for k, v in json.loads("{" + t + "}").items()} == seen
    assert [json.loads(t) for t in got["l.json"]] == [1, {"a": ","}, "x"]
    none = "document has no list or object seen"
    broken = "document is not valid JSON"
    assert issues == {"none.json": none, "flat.json": none, "broken.json": broken, "open.json": broken}
    assert set(got) == {"s.json", "l.json"}


def test_stores_and_feeds(spark, tmp_path, small_splits):
    """Stores and board payloads read in pieces, as read whole."""
    store = {f"k{i}": {"title": f"t, {i}", "status": "new", "mine": [i, {"x": "}"}]} for i in range(30)} | {"odd": 5}
    for name, doc in (("wrapped", {"version": 1, "seen": store}), ("bare", {f"b{k}": v for k, v in store.items()})):
        (tmp_path / f"{name}.json").write_text(json.dumps(doc))
    (tmp_path / "cut.json").write_text('{"seen": {"a": {"title": "x')
    good, bad = tables.read_seen_large(spark, str(tmp_path))
    whole, bad_whole = tables.read_seen_json(spark, str(tmp_path))
    rows = lambda df: sorted(tuple(map(str, r)) for r in df.collect())
    assert rows(good) == rows(whole) and rows(bad) == rows(bad_whole)

    feed = tmp_path / "feed"
    feed.mkdir()
    jobs = [{"id": i, "title": f'Dev "{i}", [x]', "company_name": "Acme", "url": f"https://r.com/{i}", "publication_date": "2024-04-01T00:00:00", "candidate_required_location": "Remote"} for i in range(25)]
    (feed / "a.json").write_text(json.dumps({"job-count": 25, "jobs": jobs}, indent=1))
    (feed / "b.json").write_text('{"nothing": 1}')
    posts, dropped = feeds.read_feed(spark, "remotive", str(feed), large_part="jobs")
    whole, dropped_whole = feeds.read_feed(spark, "remotive", str(feed))
    assert rows(posts.select(whole.columns)) == rows(whole) and posts.count() > 20
    assert dropped.count() == dropped_whole.count() > 0
