import zlib

import pytest

from graphloom.sources import files
from graphloom.sources.pdf import pdf_text

CMAP = b"/CIDInit begincmap 1 begincodespacerange <0000> <FFFF> endcodespacerange 2 beginbfchar <0001> <5317> <0002> <4EAC> endbfchar 2 beginbfrange <0010> <0012> <0041> <0020> <0021> [<006600660069> <0078>] endbfrange endcmap"


def stream(number, body, packed=True, more=b""):
    data = zlib.compress(body) if packed else body
    return b"%d 0 obj <<%s /Length %d%s>>\nstream\n%s\nendstream endobj\n" % (number, more, len(data), b" /Filter /FlateDecode" if packed else b"", data)


def made(*contents, packed=True, hidden=False):
    """A file with a page for each content, its fonts F1 (plain) and F2 (with a map)."""
    kids = b" ".join(b"%d 0 R" % (10 + i) for i in range(len(contents)))
    plain = {1: b"<</Type /Catalog /Pages 2 0 R>>", 2: b"<</Type/Pages /Kids [%s] /Count %d /Resources <</Font <</F1 3 0 R /F2 4 0 R>>>>>>" % (kids, len(contents)), 3: b"<</Type /Font /Subtype /Type1>>", 4: b"<</Type /Font /Subtype /Type0 /ToUnicode 5 0 R>>"}
    plain |= {10 + i: b"<</Type /Page /Parent 2 0 R /Contents %d 0 R>>" % (100 + i) for i in range(len(contents))}
    out = b"%PDF-1.5\n% a comment (\n"
    if hidden:
        bodies, heads, at = b"", b"", 0
        for n, body in plain.items():
            heads += b"%d %d " % (n, at)
            bodies += body + b" "
            at = len(bodies)
        out += stream(900, heads + bodies, True, b"/Type /ObjStm /N %d /First %d" % (len(plain), len(heads)))
    else:
        out += b"".join(b"%d 0 obj\n%s\nendobj\n" % x for x in plain.items())
    return out + stream(5, CMAP) + b"".join(stream(100 + i, c, packed) for i, c in enumerate(contents)) + b"trailer <</Root 1 0 R>>\n%%EOF"


ONE = rb"BT /F1 12 Tf 72 700 Td (Hello \(big\) w\157rld) Tj 0 -14 Td [(spl) -20 (it) -300 (words)] TJ T* (caf\351\
s) Tj ET"
TWO = b"BT /F2 9 Tf 1 0 0 1 0 0 Tm <00010002> Tj (\x00\x10\x00\x12) ' <0020 0021> Tj ET q BI /W 1 ID \x00)( EI Q"


@pytest.mark.parametrize("packed", [True, False])
@pytest.mark.parametrize("hidden", [True, False])
def test_text_of_pages(packed, hidden):
    assert pdf_text(made(ONE, TWO, b"", packed=packed, hidden=hidden)) == "Hello (big) world\nsplit words\ncafés\f北京\nACffix\f"


def test_files_that_cannot_be_read():
    for data in (b"", b"text", b"%PDF-1.4 /Encrypt 9 0 R", made(ONE).replace(b"/FlateDecode", b"/JBIG2Decode")):
        with pytest.raises(ValueError):
            pdf_text(data)
    assert pdf_text(b"%PDF-1.4\n1 0 obj <</Type /Catalog /Pages 1 0 R>> endobj") in ("", "\f")


def test_loader_reads_pdf_files_and_tells_of_progress(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(made(ONE))
    (tmp_path / "b.PDF").write_bytes(made(TWO, hidden=True))
    (tmp_path / "broken.pdf").write_bytes(b"%PDF nothing")
    (tmp_path / "c.txt").write_text("plain")
    told = []
    got = {r.path.rsplit("/", 1)[-1]: r.text for r in files.load_documents(spark, str(tmp_path), progress=lambda *x: told.append(x)).collect()}
    assert got == {"a.pdf": "Hello (big) world\nsplit words\ncafés", "b.PDF": "北京\nACffix", "broken.pdf": "", "c.txt": "plain"}
    assert told[-1] == (4, 4) and told == sorted(told)
    own = files.load_documents(spark, str(tmp_path), extractors={".pdf": lambda b: "mine"}).filter("loader = 'pdf'").collect()
    assert {r.text for r in own} == {"mine"}
