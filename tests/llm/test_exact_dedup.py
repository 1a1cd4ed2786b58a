import hashlib
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from conftest import unharmed
from textloom.llm import exact_dedup as D
from textloom.llm import queries as Q


def norm(t):
    return re.sub("[ \t-\r]+", " ", t or "")


def check(got, rows):
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[norm(t)].append(i)
    want = Counter()
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        for i in ids:
            want[i, min(known) if known else None, len(ids), hashlib.sha256(text.encode()).hexdigest()] += 1
    have = Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got)
    assert have == want
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert all(n == 1 for n in kept.values()) and len(kept) == len(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def rows_of(prose):
    rows = [(i, prose(20 + i % 90, i % 37), "s") for i in range(150)]
    rows += [(200 + i, prose(400, 1) + (" tail" if i % 2 else ""), "s") for i in range(40)]  # differ in the last block
    rows += [(300 + i, ("head " if i % 3 else "") + prose(400, 2), "s") for i in range(12)]
    rows += [(400, "ab" * 128, "s"), (401, "ab" * 256, "s"), (402, "ab" * 192, "s"), (403, "ab" * 128, "s"), (404, "ab" * 256, "s")]
    return rows


def test_groups(stored, prose, edge_rows):
    rows = rows_of(prose) + edge_rows
    check(D.groups(stored(rows), block=64).collect(), rows)
    check(D.groups(stored(rows)).collect(), rows)


def test_colliding_fingerprints(stored, prose, edge_rows):
    """Names stay without collisions when the fingerprint is next to useless."""
    rows = rows_of(prose) + edge_rows
    check(D.groups(stored(rows), block=64, fingerprint=lambda b: F.octet_length(b).cast("long") % 3).collect(), rows)


def test_keep_one(stored, edge_rows):
    docs = stored(edge_rows)
    kept = D.keep_one(docs)
    assert kept.columns == docs.columns and unharmed(kept)
    assert sorted(norm(r.text) for r in kept.collect()) == sorted({norm(t) for _, t, _ in edge_rows})
    assert D.groups(docs.limit(0)).count() == 0


def test_sql(spark, small, duck):
    from helpers import rows

    assert rows(Q.op4_exact_dedup(spark, small).toPandas()) == rows(duck.sql(Q.ORACLE_SQL["op4_exact_dedup"]).df())


def test_rows_without_a_place_of_their_own(make, prose, edge_rows):
    """Rows that a shuffle deals out are stored before they are numbered."""
    rows = rows_of(prose) + edge_rows
    docs = make(rows, slices=7)
    check(D.groups(docs, block=64).collect(), rows)
    kept = D.keep_one(docs)
    assert sorted(norm(r.text) for r in kept.collect()) == sorted({norm(t) for _, t, _ in rows})


def test_more_places_than_are_broadcast(stored, prose, monkeypatch):
    from textloom.llm import common

    rows = rows_of(prose)
    monkeypatch.setattr(common, "FEW", 3)
    kept = D.keep_one(stored(rows))
    assert unharmed(kept) and sorted(norm(r.text) for r in kept.collect()) == sorted({norm(t) for _, t, _ in rows})
