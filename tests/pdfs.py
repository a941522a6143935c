"""PDF files made for tests."""
import zlib


def pdf(pages, title=b"Made", packed=False, extra=b""):
    """Pages of (content, images), images of (head, data); objects plain or, if ``packed``, in an object stream."""
    plain, streams = {}, {}
    n = 10
    kids = []
    for content, images in pages:
        names = []
        for head, data in images:
            streams[n] = (b"/Type /XObject /Subtype /Image " + head, data)
            names.append(b"/Im%d %d 0 R" % (len(names), n))
            n += 1
        streams[n] = (b"/Filter /FlateDecode", zlib.compress(content))
        plain[n + 1] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R /Resources << /Font << /F1 4 0 R /F2 5 0 R >> /XObject << %s >> >> >>" % (n, b" ".join(names))
        kids.append(b"%d 0 R" % (n + 1))
        n += 2
    plain |= {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [ %s ] /Count %d >>" % (b" ".join(kids), len(kids)), 3: b"<< /Title (%s) /Author <FEFF00C8> >>" % title}
    plain[4] = b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding << /Type /Encoding /BaseEncoding /WinAnsiEncoding /Differences [ 200 /eacute /uni20AC ] >> >>"
    plain[5] = b"<< /Type /Font /Subtype /Type0 /Encoding /Identity-H /ToUnicode 6 0 R >>"
    streams[6] = (b"", b"1 begincodespacerange <0000> <FFFF> endcodespacerange 2 beginbfchar <0001> <0041> <0002> <00660069> endbfchar 1 beginbfrange <0010> <0012> <0062> endbfrange")
    out = b"%PDF-1.5\n" + extra
    if packed:
        body, heads = b"", b""
        for k, v in plain.items():
            heads += b"%d %d " % (k, len(body))
            body += v + b" "
        streams[8] = (b"/Type /ObjStm /N %d /First %d /Filter /FlateDecode" % (len(plain), len(heads)), zlib.compress(heads + body))
        streams[9] = (b"/Type /XRef /Root 1 0 R /Info 3 0 R", b"")
        plain = {}
    for k, v in plain.items():
        out += b"%d 0 obj\n%s\nendobj\n" % (k, v)
    for k, (head, data) in streams.items():
        out += b"%d 0 obj\n<< %s /Length %d >>\nstream\n%s\nendstream\nendobj\n" % (k, head, len(data), data)
    return out + (b"" if packed else b"trailer << /Root 1 0 R /Info 3 0 R >>\n") + b"%%EOF"


RGB = (b"/Width 2 /Height 1 /BitsPerComponent 8 /ColorSpace /DeviceRGB", b"\xff\x00\x00\x00\xff\x00")
CMYK = (b"/Width 1 /Height 1 /BitsPerComponent 8 /ColorSpace /DeviceCMYK /Filter /FlateDecode", zlib.compress(b"\x00\xff\xff\x00"))
JPEG = (b"/Width 7 /Height 9 /BitsPerComponent 8 /ColorSpace /DeviceRGB /Filter /DCTDecode", b"\xff\xd8jpeg\xff\xd9")
FIRST = b"BT /F1 12 Tf 72 700 Td (First line, with \\(brackets\\) and \\310\\311.) Tj 0 -14 Td (second ) Tj [(li) 20 (ne) -300 (end)] TJ 0 -60 Td (name | value) Tj 0 -14 Td (a | 1) Tj 0 -14 Td (b | 2) Tj ET q /Im0 Do Q /Im1 Do"
SECOND = b"BT /F2 12 Tf 72 700 Td <0001000200100012> Tj ET /Im0 Do"


def sample(**more):
    return pdf([(FIRST, [RGB, CMYK]), (SECOND, [JPEG]), (b"", [])], **more)
