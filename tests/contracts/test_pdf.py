"""PDF files written here, read page by page: by the data source in ranges, by the binary scan, and as laid-out pages."""

import zlib

import pytest

from pactlake.sources import documents, pdf

PAGES = [
    [(300, 700, "right half"), (72, 702, "MASTER AGREEMENT"), (72, 650, "1. Fees (net)"), (72, 640.5, "are paid\\within 30 days")],
    [],
    [(72, 700, "Source: page three"), (72, 500, "déjà vu")],
    *[[(72, 700, f"Page number {i}")] for i in range(4, 24)],
]


def escaped(text):
    return b"(" + text.encode("latin-1").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)") + b")"


def content(fragments):
    return b"q 1 0 0 1 0 0 cm BT /F1 12 Tf " + b" ".join(b"1 0 0 1 %g %g Tm %s Tj" % (x, y, escaped(t)) for x, y, t in fragments) + b" ET Q"


def written_pdf(pages, flate=True, packed=False):
    """A file with a page tree of two levels; packed: dictionaries in an object stream."""
    half = (len(pages) + 1) // 2
    first = lambda i: 10 + 2 * i
    kids = lambda lo, hi: b" ".join(b"%d 0 R" % first(i) for i in range(lo, hi))
    plain = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Count %d /Kids [3 0 R 4 0 R] >>" % len(pages), 3: b"<< /Type /Pages /Parent 2 0 R /Kids [%s] >>" % kids(0, half), 4: b"<< /Type /Pages /Parent 2 0 R /Kids [%s] >>" % kids(half, len(pages))}
    streams = {}
    for i, fragments in enumerate(pages):
        plain[first(i)] = b"<< /Type /Page /Parent 3 0 R /Contents [%d 0 R] >>" % (first(i) + 1)
        body = content(fragments)
        streams[first(i) + 1] = (b"/Filter /FlateDecode ", zlib.compress(body)) if flate else (b"", body)
    if packed:
        heads, bodies = b"", b""
        for number, body in plain.items():
            heads += b"%d %d " % (number, len(bodies))
            bodies += body + b" "
        whole = zlib.compress(heads + bodies)
        plain, streams[5] = {}, (b"/Type /ObjStm /N %d /First %d /Filter /FlateDecode " % (len(plain), len(heads)), whole)
    out = b"%PDF-1.5\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % x for x in plain.items())
    for number, (head, body) in streams.items():
        out += b"%d 0 obj\n<< %s/Length %d >>\nstream\n%s\nendstream\nendobj\n" % (number, head, len(body), body)
    return out + b"trailer << /Root 1 0 R >>\n%%EOF"


def places(df):
    return sorted(((r["page"], r["x"], r["y"], r["text"]) for r in df.collect() if r["text"] is not None))


@pytest.mark.parametrize(("flate", "packed"), [(True, False), (False, False), (True, True)])
def test_fragments_by_range_and_by_scan(spark, tmp_path, flate, packed):
    path = tmp_path / "contract.pdf"
    path.write_bytes(written_pdf(PAGES, flate, packed))
    want = sorted((n, float(x), float(y), t) for n, page in enumerate(PAGES, 1) for x, y, t in page)
    scanned = documents.pdf_fragments(spark, [str(path)])
    ranged = documents.pdf_fragments(spark, [str(path)], range_bytes=500)
    assert ranged.rdd.getNumPartitions() > 3
    assert places(scanned) == want and places(ranged) == want
    assert {(r["source"], r["total_pages"]) for r in ranged.collect()} == {("contract.pdf", len(PAGES))}
    assert sorted({r["page"] for r in ranged.collect()}) == list(range(1, len(PAGES) + 1))  # the empty page too


def test_pages_follow_the_layout(spark, tmp_path):
    path = tmp_path / "contract.pdf"
    path.write_bytes(written_pdf(PAGES))
    (tmp_path / "note.txt").write_text("one page")
    pages = {(r["source"], r["page"]): r for r in documents.load_documents(spark, [str(path), str(tmp_path / "note.txt")]).collect()}
    assert pages["contract.pdf", 1]["text"] == "MASTER AGREEMENT right half\n1. Fees (net)\nare paid\\within 30 days"
    assert pages["contract.pdf", 2]["text"] == "" and pages["contract.pdf", 3]["text"] == "Source: page three\ndéjà vu"
    assert pages["contract.pdf", 5]["page_label"] == "5" and pages["note.txt", 1]["text"] == "one page"
    with pytest.raises(ValueError, match="unsupported"):
        documents.load_documents(spark, ["x.docx"])


def test_files_without_pages_and_missing_files(spark, tmp_path):
    (tmp_path / "odd.pdf").write_bytes(b"%PDF-1.4 no objects")
    assert documents.pdf_fragments(spark, [str(tmp_path / "odd.pdf")]).count() == 0
    with pytest.raises(Exception, match="nowhere.pdf"):
        documents.pdf_fragments(spark, [str(tmp_path / "nowhere.pdf")], range_bytes=1000).collect()


def test_operators_of_a_content_stream():
    stream = rb"BT 14 TL 10 700 Td (a\051\)\\) Tj ( b) Tj T* [(Wo) -50 (rd) -300 (next)] TJ 0 -20 TD <48 69> Tj (new) ' ET BT 5 5 Td (\376\377\000A\000B) Tj ET"
    assert pdf.fragments_of(stream) == [(10, 700, "a))\\ b"), (10, 686, "Word next"), (10, 666, "Hi"), (10, 646, "new"), (5, 5, "AB")]
    assert pdf.fragments_of(b"") == [] and pdf.fragments_of(b"BT Tj TJ Tm ET") == []


def test_damaged_streams_are_empty():
    file = pdf.PdfFile(written_pdf(PAGES[:3]).replace(b"x\x9c", b"\x00\x00"))
    assert len(file.pages) == 3 and file.fragments(0) == []
