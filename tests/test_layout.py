"""The layout scan against a plain reading of the same pages."""

import json
import random
import re

from pyspark.sql import functions as F

from quirelake.functions import text as T
from quirelake.sources import layout as S

WORDS = ["Nets", "work", "[1]", "[2, 4]", "as", "Kipf", "(2017)", "et", "al.", "Graphs", "help.", "They", "e.g.", "[3-5].", "fast", "No", "more!", "of"]


def block(texts, size=10.0, x0=50.0, y0=0.0, kind=0):
    lines = [{"bbox": [x0, y0 + 12 * i, 300, y0 + 12 * i + 10], "spans": [{"text": t[: len(t) // 2], "size": size}, {"text": t[len(t) // 2 :], "size": size}]} for i, t in enumerate(texts)]
    return {"type": kind, "bbox": [x0, y0, 300, y0 + 12 * len(texts) - 2], "lines": lines}


def pages(seed):
    rng = random.Random(seed)
    out = []
    for n in range(1, 4):
        y, found = 0.0, []
        for _ in range(rng.randrange(0, 9)):
            y += rng.choice([5.0, 12.0, 16.0, 30.0, -20.0])
            if rng.random() < 0.2:
                b = block([rng.choice(["1 Introduction", "Deep Methods Here", "small words", "REFERENCES", "2"])], size=rng.choice([14.0, 10.0]), y0=y)
            elif rng.random() < 0.1:
                b = block(["picture [9]"], y0=y, kind=1)
            else:
                b = block([" ".join(rng.choices(WORDS, k=rng.randrange(0, 8))) for _ in range(rng.randrange(1, 4))], x0=50.0 + rng.choice([0, 0, 8, 20]), y0=y)
            found.append(b)
            y = b["bbox"][3]
        out.append({"number": n, "blocks": found})
    return {"pages": out}


def plain_heading(text, size, body):
    lines = [" ".join(x.split()) for x in text.split("\n") if x.strip()]
    if not lines or size < body + 1.5:
        return None
    name = f"{lines[0]} {lines[1]}" if len(lines) > 1 and re.fullmatch(r"\d+(\.\d+)*|[A-Z]", lines[0]) else lines[0]
    words = re.findall(r"[A-Za-z][A-Za-z'\-]*", name)
    formed = name.lower().startswith(("references", "bibliography")) or re.match(r"\d+(\.\d+)*\s+\S", name) or name.isupper() or (words and sum(w[0].isupper() for w in words) >= 0.6 * len(words))
    return name if len(name) <= 80 and not name.endswith(".") and formed else None


def plain(doc):
    """(page, paragraph, line, section, number) of numeric citations, page by page, block by block."""
    lengths = {}
    for p in doc["pages"]:
        for b in p["blocks"]:
            for x in b["lines"] if b["type"] == 0 else []:
                for s in x["spans"]:
                    if s["text"]:
                        lengths[s["size"]] = lengths.get(s["size"], 0) + len(s["text"])
    body = max(lengths, key=lengths.get) if lengths else 0.0
    out, paragraph, section = [], 0, 0
    of = lambda x: "".join(s["text"] for s in x["spans"])
    for p in doc["pages"]:
        groups, last = [], None
        for b in (b for b in p["blocks"] if b["type"] == 0):
            sizes = [s["size"] for x in b["lines"] for s in x["spans"]]
            headed = bool(plain_heading(of(b["lines"][0]).strip(), sum(sizes) / len(sizes), body))
            joins = False
            if last is not None and not headed and not last[1]:
                before = last[0]
                gap = b["bbox"][1] - before["bbox"][3]
                ended = re.search(r"[.!?]['\"”’)]*$", of(before["lines"][-1]).strip())
                joins = -2 <= gap <= 16 and abs(b["bbox"][0] - before["bbox"][0]) <= 10 and (not ended or of(b["lines"][0])[:1].islower())
            groups[-1].append(b) if joins else groups.append([b])
            last = (b, headed)
        for g in groups:
            paragraph += 1
            text, starts = "", []
            lines = [x for b in g for x in b["lines"] if of(x).strip()]
            for x in lines:
                text += "\n" if text else ""
                starts.append((len(text), len(text) + len(of(x))))
                text += of(x)
            if not text.strip():
                continue
            if plain_heading(text, max(sum(s["size"] for s in x["spans"]) / 2 for x in lines), body):
                section += 1
                continue
            begin, spans = 0, []
            for m in re.finditer(T.SENTENCE_END, text):
                if text[begin : m.start()].strip().lower().endswith(T.ABBREVIATIONS):
                    continue
                spans.append((begin, m.start()))
                begin = m.end()
            for a, b in [*spans, (begin, len(text))]:
                line = next((i for i, (s, e) in enumerate(starts, 1) if s <= a < e or a <= s < b), 0)
                for marker in re.findall(r"\[[0-9, -]+\]", " ".join(text[a:b].split())):
                    for part in marker.strip("[]").split(","):
                        lo, _, hi = part.strip().partition("-")
                        out += [(p["number"], paragraph, line, section or None, n) for n in range(int(lo), int(hi or lo) + 1)]
    return sorted(out, key=str)


def test_scan_against_a_plain_reading(spark):
    docs = {f"p{k}": pages(k) for k in range(40)}
    rows = [(k, json.dumps(d)) for k, d in docs.items()]
    parts = S.paragraphs(spark.createDataFrame(rows, "paper_id string, layout string").repartition(3))
    got = {k: [] for k in docs}
    for r in S.citations(parts).where("kind = 'numeric'").collect():
        got[r.paper_id].append((r.page, r.paragraph_index, r.line_in_paragraph, r.section_index, r.reference_number))
    want = {k: plain(d) for k, d in docs.items()}
    assert sum(map(len, want.values())) > 300 and len({x[2] for v in want.values() for x in v}) > 2
    assert {k: sorted(v, key=str) for k, v in got.items()} == want


def test_sections_and_known_headings(spark):
    doc = {"pages": [{"blocks": [block(["A Survey of Nets"], 16.0, y0=0), block(["Text of the body goes here [1]."], y0=40), block(["1", "Introduction"], 14.0, y0=80), block(["Body again [2]."], y0=140)]}]}
    rows = spark.createDataFrame([("p", json.dumps(doc), ["1 Introduction", "2 Methods", "References"])], "paper_id string, layout string, known array<string>")
    found = [tuple(r)[1:] for r in S.sections(S.paragraphs(rows)).orderBy("section_index").collect()]
    assert found == [(1, "A Survey of Nets", 1, 1, 1, "title"), (2, "1 Introduction", 1, 3, 1, "introduction")]
    assert [r.section_title for r in S.sections(S.paragraphs(rows, headings="known")).collect()] == ["1 Introduction"]
    boxes = {r.reference_number: r.bbox for r in S.citations(S.paragraphs(rows)).collect()}
    assert boxes == {1: [50.0, 40.0, 300.0, 50.0], 2: [50.0, 140.0, 300.0, 150.0]}


def test_odd_layouts(spark):
    rows = [("a", None), ("b", "no json"), ("c", "{}"), ("d", json.dumps({"pages": []})), ("e", json.dumps({"pages": [{"blocks": [{"type": 0}, {"type": 0, "lines": [{"spans": None}]}]}]}))]
    rows.append(("f", json.dumps({"pages": [{"blocks": [{"type": "text", "lines": [{"spans": [{"text": "No box [7]."}]}]}]}]})))
    parts = S.paragraphs(spark.createDataFrame(rows, "paper_id string, layout string"))
    assert [(r.paper_id, r.page, r.line_in_paragraph, r.bbox, r.reference_number) for r in S.citations(parts).collect()] == [("f", 1, 1, None, 7)]
    assert S.paragraphs(spark.createDataFrame([], "paper_id string, layout string")).count() == 0


def test_places_of_sentences(spark):
    text = "One [1]. Two et al. Three.\n Four!  5 ends"
    got = spark.range(1).select(S.placed_sentences(F.lit(text)).alias("s")).first()["s"]
    assert [(s.text, text[s.start : s.end]) for s in got] == [("One [1].", "One [1]."), ("Two et al. Three.", "Two et al. Three."), ("Four!", "Four!"), ("5 ends", "5 ends")]
