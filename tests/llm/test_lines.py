import random

import pytest

from ledgerline.llm import line_dedup
from tests.llm.cases import documents, nothing


def brute(rows, least):
    """(id, site, text) to the texts that stay."""
    key = lambda line: " ".join(line.replace("\t", " ").split(" ")).lower() and " ".join(x for x in line.lower().replace("\t", " ").replace("\r", " ").split(" ") if x)
    sites, first = {}, {}
    for doc, site, text in rows:
        for pos, line in enumerate((text or "").split("\n")):
            if key(line):
                if site is not None:
                    sites.setdefault(key(line), set()).add(site)
                if doc is not None:
                    first[key(line)] = min(first.get(key(line), (doc, pos)), (doc, pos))
    out = []
    for doc, _, text in rows:
        lines = (text or "").split("\n")
        stay = [line for pos, line in enumerate(lines) if len(sites.get(key(line), ())) < least or (doc, pos) == first.get(key(line))]
        out.append((doc, None if text is None else "\n".join(stay), 0 if text is None else len(lines), len(lines) - len(stay)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_lines_go_by_their_sites(spark, seed):
    rng = random.Random(seed)
    common = [f"Line  {i} of\tall" for i in range(12)]
    texts, sites = [], []
    for n in range(300):
        site = f"s{n % 14}"
        lines = [rng.choice([common[i].upper(), common[i] + " ", common[i]]) for i in range(12) if rng.random() < i / 24 and n % 14 <= i + 2]
        lines += [f"own line {n} {i}" for i in range(rng.randrange(4))] + [""] * rng.randrange(3)
        rng.shuffle(lines)
        texts.append("\n".join(lines))
        sites.append(site)
    texts += [None, "", "\n\n", common[11], common[11], common[11] + "\n" + common[11]]
    sites += ["s1", "s2", "s3", None, "s5", "s6"]
    ids = [*range(1000, 1300), 1, 2, 3, 900, None, 0]
    found = line_dedup.clean(documents(spark, texts, ids, sites))
    got = [(r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in found.collect()]
    assert sorted(got, key=repr) == brute(list(zip(ids, sites, texts, strict=True)), line_dedup.LEAST_SITES)
    assert sum(x[3] for x in got) > 100


def test_rows_repeated_and_rows_with_one_id(spark):
    texts, sites = ["x\ncommon"] * 3 + ["common\ny", "common\ny"], ["a", "b", "c", "d", "e"]
    got = line_dedup.clean(documents(spark, texts, [5, 5, 5, 9, 9], sites), least_sites=5).collect()
    assert sorted(r["text"] for r in got) == ["x\ncommon"] * 3 + ["y", "y"]


def test_sketches_leave_the_decision_near_the_threshold_to_exact_counts(spark):
    rows = [(f"line {sites}", f"s{site}", site) for sites in (97, 99, 100, 101, 103) for site in range(sites)]
    docs = documents(spark, [r[0] for r in rows], list(range(len(rows))), [r[1] for r in rows])
    found = line_dedup.clean(docs, least_sites=100).where("n_removed > 0").count()
    assert found == 100 + 101 + 103 - 3


def test_no_rows(spark):
    found = line_dedup.clean(nothing(spark))
    assert found.count() == 0 and found.columns[-2:] == ["n_lines", "n_removed"]
