"""Passes that a recogniser reads only where they are needed."""

import json
import os
import uuid

import pandas as pd
import pytest
from test_recovery import ID

from veilwork.functions import geometry as G
from veilwork.operators import passes
from veilwork.sources.tokens import with_recognizer

OTHER = f"doc_id long, page_index long, kind string, bbox {G.BOX}, mask_bbox {G.BOX}, value string, confidence double, suspicious boolean"
READ = "doc_id long, page_index long, rotation int, band int, line_id long, token_seq int, text string, x double, y double, w double, h double, confidence double"
W, H = 1000, 600


def inline(y, x=600.0, w=120.0, line=0):
    return [{"line_id": line, "token_seq": 0, "text": ID, "x": x, "y": float(y), "w": float(w), "h": 20.0}]


def triplet(y, line):
    return [{"line_id": line, "token_seq": i, "text": ID[4 * i : 4 * i + 4], "x": 20.0 + 50 * i, "y": float(y), "w": 40.0, "h": 20.0} for i in range(3)]


SUSPICIOUS = inline(50, x=20.0, w=700.0)


def loader(log):
    """A recogniser that reads what a page's script says, and notes each page that it is asked for."""

    def load():
        def recognise(batch):
            out = []
            for r in batch.to_dict("records"):
                name = r["pass"] + (f" {r['rotation']}" if r["pass"] in ("probe", "turned") else f" {r['band']}" if r["pass"] == "band" else "")
                with open(os.path.join(log, uuid.uuid4().hex), "w") as f:
                    json.dump([r["doc_id"], name], f)
                script = json.loads(r["script"])
                tokens = script.get(name, [])
                if r["pass"] == "band":
                    tokens = [t | {"y": t["y"] - r["y0"]} for t in script.get("rows", []) if t["y"] >= r["y0"] and t["y"] + t["h"] <= r["y1"]]
                out += [{"doc_id": r["doc_id"], "page_index": r["page_index"], "rotation": r["rotation"], "band": int(r.get("band", 0)), "confidence": 0.95, **t} for t in tokens]
            return pd.DataFrame(out, columns=[c.split()[0] for c in READ.split(", ")])

        return recognise

    return load


def detected(spark, tmp_path, documents, faces=(), auto_rotate=False):
    """documents: {doc_id: (kind, script)}. Gives what was found and which passes were read of each document."""
    log = tmp_path / uuid.uuid4().hex
    log.mkdir()
    pages = spark.createDataFrame([(d, 0, W, H, k, json.dumps(s)) for d, (k, s) in documents.items()], "doc_id long, page_index long, width long, height long, kind string, script string")
    box = lambda x: (float(x), 1.0, 5.0, 5.0)
    hits = spark.createDataFrame([(d, 0, "face", box(x), box(x), "face", 0.9, False, r) for d, x, r in faces], OTHER + ", rotation int")
    others = lambda wanted, _: hits.join(wanted.select("doc_id", "page_index", "rotation"), ["doc_id", "page_index", "rotation"], "left_semi")
    found = passes.reconcile_on_demand(pages, passes.recogniser(loader(str(log)), READ), others, auto_rotate).collect()
    calls = {d: [] for d in documents}
    for f in log.iterdir():
        d, name = json.loads(f.read_text())
        calls[d].append(name)
    return found, {d: sorted(c) for d, c in calls.items()}


def test_recovery_of_images_and_pdfs(spark, tmp_path):
    cases = [
        {"first": SUSPICIOUS + triplet(400, 1), "rows": triplet(400, 0)},
        {"first": SUSPICIOUS + triplet(400, 1), "rows": triplet(50, 0) + triplet(400, 1)},
        {"first": SUSPICIOUS, "rows": inline(50)},
        {"first": SUSPICIOUS + triplet(400, 1), "rows": inline(50)},
        {"first": [], "rows": triplet(50, 0) + triplet(400, 1)},
    ]
    documents = {10 * i + j: (kind, c) for i, c in enumerate(cases) for j, kind in enumerate(("image", "pdf"))}
    found, calls = detected(spark, tmp_path, documents)
    for kind in (0, 1):
        of = lambda case: sorted((r.mask_bbox.y, r.mask_bbox.x, r.mask_bbox.w, r.suspicious) for r in found if r.doc_id == 10 * case + kind)
        assert [(y, s) for y, _, _, s in of(0)] == [(50.0, True), (400.0, False)]
        assert of(1) == [(50.0, 20.0, 90.0, False), (400.0, 20.0, 90.0, False)]
        assert of(2) == [(50.0, 600.0, 80.0, False)]
        assert [(y, s) for y, _, _, s in of(3)] == [(50.0, False), (400.0, False)] and of(3)[0][1] == 600.0
        assert [y for y, *_ in of(4)] == [50.0, 400.0]
    # The band that settles every doubt is the last one read; a PDF page is never read enhanced.
    assert calls[20] == calls[21] == ["band 0", "band 1", "first"]
    assert calls[40] == ["band 0", "band 1", "band 2", "enhanced", "first"] and calls[41] == ["band 0", "band 1", "band 2", "first"]


def test_passes_that_are_read(spark, tmp_path):
    documents = {
        1: ("image", {"first": triplet(10, 0)}), 2: ("image", {"enhanced": triplet(10, 0), "turned 90": triplet(10, 0)}), 3: ("image", {"probe 90": triplet(10, 0), "turned 90": inline(30)}),
        4: ("image", {}), 5: ("pdf", {"enhanced": triplet(10, 0), "rows": triplet(80, 0)}), 6: ("blob", {"enhanced": triplet(10, 0), "rows": triplet(80, 0)}), 7: ("blob", {"first": SUSPICIOUS}),
    }
    faces = [(d, d, 0) for d in documents] + [(3, 33, 90)]
    found, calls = detected(spark, tmp_path, documents, faces, auto_rotate=True)
    got = sorted((r.doc_id, r.kind, r.bbox.x, r.bbox.y, r.rotation) for r in found)
    ids = [(1, "aadhaar", 20.0, 10.0, 0), (2, "aadhaar", 20.0, 10.0, 0), (3, "aadhaar", 600.0, 30.0, 90), (5, "aadhaar", 20.0, 80.0, 0), (7, "aadhaar", 20.0, 50.0, 0)]
    assert got == sorted(ids + [(d, "face", float(d), 1.0, 0) for d in (1, 2, 4, 5)] + [(3, "face", 33.0, 1.0, 90)])
    probes, bands = [f"probe {r}" for r in (180, 270, 90)], [f"band {b}" for b in range(3)]
    assert calls == {
        1: ["first"], 2: ["enhanced", "first"], 3: ["enhanced", "first", *probes, "turned 90"], 4: [*bands, "enhanced", "first", *probes],
        5: [*bands, "first"], 6: ["first"], 7: ["first"],
    }


@pytest.mark.parametrize(("failures", "works"), [(1, True), (2, False)])
def test_recogniser_starts_again_and_is_closed(spark, tmp_path, failures, works):
    folder = str(tmp_path)

    def load():
        tries = len([n for n in os.listdir(folder) if n.startswith("try")])
        open(os.path.join(folder, f"try{tries}"), "w").close()
        if tries < failures:
            raise RuntimeError("no start")

        class Reader:
            def __call__(self, batch):
                return batch

            def close(self):
                open(os.path.join(folder, "closed"), "w").close()

        return Reader()

    df = with_recognizer(spark.range(5).coalesce(1), load, "id long")
    if works:
        assert df.count() == 5
        assert "closed" in os.listdir(folder)
    else:
        with pytest.raises(Exception, match="no start"):
            df.count()
    assert len([n for n in os.listdir(folder) if n.startswith("try")]) == 2
