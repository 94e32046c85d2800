import random
import re

import pytest

from tests.conftest import SF
from threadloom.llm import license_scan
from threadloom.llm.queries import op2_license_scan


def words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def grams(w, k):
    return [tuple(w[j : j + k]) for j in range(len(w) - k + 1)]


def brute(rows, templates):
    """(doc_id, license) to the best containment in any window of the template's class, and its first word."""
    best = {}
    for i, text in rows:
        w = words(text)
        for family, name, template in templates:
            t = words(template)
            k = 5 if len(t) >= 20 else min(3, len(t))
            own = set(grams(t, k))
            half = 1 << (len(t) - k).bit_length()
            ours = grams(w, k)
            for s in range(0, len(ours), half):
                share = len(own & set(ours[s : s + 2 * half])) / len(own)
                if share >= 0.8:
                    at = next(j for j in range(s, len(ours)) if ours[j] in own)
                    best[i, family, name] = min(best.get((i, family, name), (0, 0, 0)), (-share, at, half))
    beaten = lambda key, x: any(k[:2] == key[:2] and y[0] < x[0] and abs(y[1] - x[1]) < 2 * x[2] for k, y in best.items())
    return {(i, name): (-x[0], x[1]) for (i, family, name), x in best.items() if not beaten((i, family, name), x)}


def result(frame):
    return {(r["doc_id"], r["license"]): (r["containment"], r["position"]) for r in frame.collect()}


def same(found, wanted):
    assert found.keys() == wanted.keys() and all(found[k] == pytest.approx(wanted[k]) for k in wanted)


def test_query_equals_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    found = result(op2_license_scan(spark, SF))
    same(found, brute(docs, license_scan.TEMPLATES))
    assert found


def test_whole_texts_and_versions(spark):
    of = {name: max((t for _, n, t in license_scan.TEMPLATES if n == name), key=len) for _, name, _ in license_scan.TEMPLATES}
    names = sorted(of)
    long = " ".join(f"w{i}" for i in range(3000))
    rows = [(i, f"{long} {of[name].upper()}\n{long}") for i, name in enumerate(names)]
    rows.append((100, f"{of['GPL-3.0']} {long} {of['GPL-2.0']}"))
    rows.append((101, of["GPL-2.0"].replace("version 2", "version 9")))
    found = result(license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")))
    same(found, brute(rows, license_scan.TEMPLATES))
    assert {k for k in found if k[0] < 100} == set(enumerate(names))
    assert {n for i, n in found if i == 100} == {"GPL-2.0", "GPL-3.0"} and {n for i, n in found if i == 101} == {"GPL-2.0", "GPL-3.0"}
    assert all(found[i, name][1] == 3000 for i, name in enumerate(names) if len(words(of[name])) > 20)


def test_altered_notices(spark):
    rows = [(5, "released under the mit licence"), (6, "RELEASED, under the MIT-License"), (7, "all rights reserved all rights reserved"), (8, "Licensed under the MIT License, (c) me"), (9, "work is licensed under the GNU General Public License, version 3"), (10, "Licensed under CC BY-SA 4.0")]
    found = result(license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")))
    same(found, brute(rows, license_scan.TEMPLATES))
    assert set(found) == {(6, "MIT"), (7, "proprietary"), (8, "MIT"), (9, "GPL-3.0"), (10, "CC-BY-SA-4.0")}


def test_band_recall(spark):
    """Bands find what exact containment finds, down to its limit: altered texts at random places."""
    rng, rows = random.Random(0), []
    for i in range(600):
        w = words(rng.choice([t for _, _, t in license_scan.TEMPLATES if len(words(t)) >= 20]))
        for _ in range(rng.randrange(0, 1 + len(w) // 28)):
            w[rng.randrange(len(w))] = f"x{i}"
        around = [f"y{rng.randrange(10**6)}" for _ in range(rng.randrange(800))]
        cut = rng.randrange(len(around) + 1)
        rows.append((i, " ".join(around[:cut] + w + around[cut:])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    wanted, found = brute(rows, license_scan.TEMPLATES), result(license_scan.scan(docs))
    assert len(wanted) > 450 and found.keys() <= wanted.keys() and len(found) >= 0.99 * len(wanted)


def test_edge_cases(spark):
    rows = [(None, None), (1, ""), (2, "MIT"), (None, "All rights reserved"), (3, "All rights reserved"), (3, "All rights reserved"), (4, "w " * 50_000 + "All rights reserved")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as license", "2 as position", "3 as x", "4 as half", "5 as family")
    assert result(license_scan.scan(docs)) == {(None, "proprietary"): (1.0, 0), (3, "proprietary"): (1.0, 0), (4, "proprietary"): (1.0, 50_000)}
    assert license_scan.scan(docs, []).count() == 0 and license_scan.scan(docs, [("x", "x", " ")]).count() == 0
    assert license_scan.scan(docs.limit(0)).count() == 0
