"""Archives and PDFs that follow each other or lie in each other."""

import io
import zipfile

import pytest

from lodestone.llm import media


def archive(files, note=b""):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as made:
        for name, data in files.items():
            made.writestr(name, data)
        made.comment = note
    return out.getvalue()


def pdf(body=b"", updates=0):
    out = b"%PDF-1.4\n1 0 obj\n<<>>\nstream\n" + body + b"\nendstream\nendobj\n"
    for _ in range(updates + 1):
        out += b"xref\n0 1\ntrailer\n<<>>\nstartxref\n%d\n%%%%EOF\n" % len(out)
    return out.rstrip(b"\n")


def carved(payload):
    return [x for x in media.sniff(payload, media.signature_automaton()) if x[2] in ("application/zip", "application/pdf")]


@pytest.mark.parametrize("note", [b"", b"a note"])
def test_zip(note):
    one, two, kind = archive({"a": b"first", "b": b"x"}, note), archive({"c": b"second"}), "application/zip"
    assert carved(one + b"between" + two) == [(0, len(one), kind), (len(one) + 7, len(two), kind)]
    assert carved(one + one) == [(0, len(one), kind), (len(one), len(one), kind)]
    outer = archive({"pad": b"1234", "inner.zip": one})
    assert carved(outer) == [(0, len(outer), kind), (outer.index(one), len(one), kind)]
    assert carved(one[:-1] if note else one[:-2]) == []


def test_pdf():
    kind = "application/pdf"
    for one in (pdf(b"first"), pdf(b"first", updates=2)):
        two = pdf(b"the second one")
        for other in (one, two):
            payload = one + b"\n" + other
            assert carved(payload) == [(0, len(one), kind), (len(one) + 1, len(other), kind)]
    outer = pdf(one)
    assert carved(outer) == [(0, len(outer), kind), (outer.index(one), len(one), kind)]
    wrong = one.replace(b"startxref\n", b"startxref\n9")
    assert carved(b"x" + wrong + b"\n") == [(1, len(wrong), kind)]
    assert carved(one.replace(b"startxref", b"startxxxx")) == []
