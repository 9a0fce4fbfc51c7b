"""What contexts let op7 find beyond the base patterns, planted among driver documents."""

import numpy as np


def planted(n=60):
    """Documents of the smallest table; some end in a phone number, card or address in a context that repeats, or a number in one that says nothing."""
    import duckdb

    rng = np.random.default_rng(98)
    texts = [t for (t,) in duckdb.sql("SELECT text FROM '/root/testdata/sf0.01/documents.parquet' WHERE length(text) BETWEEN 50 AND 3000 ORDER BY doc_id").fetchall()]
    digits = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    card = lambda: next(c for c in iter(lambda: "4" + digits(15), None) if sum(int(d) if i % 2 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(c)) % 10 == 0)
    rows, truth, decoys = [], {}, {}
    for k in range(len(texts)):
        text, kind = texts[k], k % 8
        if kind == 0:
            text += f"\nreach our desk at +1 555 {digits(3)} {digits(4)} before noon"
        elif kind == 1:
            text += f"\nbilled to card {card()} in full"
        elif kind == 2:
            text += f"\nwrite to sales{digits(3)}@shop{digits(2)}.example for quotes"
        elif kind == 3 and k < n * 8:
            own = [f"555 {digits(3)} {digits(4)}", f"{digits(15)}0", f"sales{digits(3)} [at] shop{digits(2)} [dot] example"][k // 8 % 3]
            lead, tail = [("\nreach our desk at ", " before noon"), ("\nbilled to card ", " in full"), ("\nwrite to ", " for quotes")][k // 8 % 3]
            name = ("phone", "card", "email")[k // 8 % 3]
            truth[k] = (name, len(text) + len(lead), len(text) + len(lead) + len(own))
            text += lead + own + tail
        elif kind == 4:
            own = digits(9)
            decoys[k] = len(text) + 14
            text += f"\nshipment lot {own} was counted at gate {digits(1)}"
        rows.append((k, text))
    return rows, truth, decoys


def test_contexts_find_loose_identifiers(spark):
    """Recall and precision of the spans that are added to the base ones."""
    from tessella.llm.pii import find_pii

    rows, truth, decoys = planted()
    added = {}
    for r in find_pii(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect():
        added[r.doc_id] = set(filter(None, r.spans.split(","))) - set(filter(None, r.base.split(",")))
    # a card whose check digit happens to be right is a base span
    want = {k: f"{kind}:{a}:{b}" for k, (kind, a, b) in truth.items()}
    base_hits = {r.doc_id for r in find_pii(spark.createDataFrame([x for x in rows if x[0] in truth], "doc_id long, text string")).collect() if want[r.doc_id] in r.base.split(",")}
    loose = {k: v for k, v in want.items() if k not in base_hits}
    found = sum(v in added[k] for k, v in loose.items())
    total = sum(len(v) for v in added.values())
    print(f"planted {len(loose)}, found {found}, added {total}")
    assert found >= 0.9 * len(loose)
    assert found >= 0.9 * total
    assert not any(added[k] for k in decoys)
