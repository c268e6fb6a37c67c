from treeloom.operators.inspect import inspect_files, with_shown


def _classify(spark, files_of, entries, **kw):
    df = with_shown(inspect_files(files_of({"r": entries}), **kw))
    return {"/".join(r["path"]): r for r in df.collect()}


def test_kinds_types_and_markers(spark, files_of):
    word = "Grüße 🌲 wide"
    gif = b"GIF87a" + bytes(range(1, 7))
    got = _classify(spark, files_of, {
        "logo": gif,
        "table.dat": b"\x00\x05\x06\x07",
        "colours.txt": b"\x1b[1mbold\x1b[0m done\n",
        "paper.txt": b"%PDF-1.7\n\x01\x02\x03\x04",
        "wide.csv": b"\xff\xfe" + word.encode("utf-16-le"),
        "sheet.v2.png": bytes.fromhex("C0C1FE"),
        "noext": bytes.fromhex("C0C1FE"),
        "letter.gif": b"just words",
    })
    logo = got["logo"]
    assert (logo["kind"], logo["meta"]["size"], logo["meta"]["mime_type"], logo["meta"]["detected_by"]) == (
        "binary", len(gif), "image/gif", "content signature")
    assert logo["shown"] == ("[Binary file not shown; MIME: image/gif; detected by: content signature; "
                             f"size: {len(gif)} bytes; detected extension: gif]")
    assert got["table.dat"]["kind"] == "binary"
    assert got["colours.txt"]["kind"] == "text" and got["colours.txt"]["text"].startswith("\x1b[1m")
    assert got["paper.txt"]["meta"]["mime_type"] == "application/pdf"
    assert got["wide.csv"]["text"] == word
    by_name = got["sheet.v2.png"]["meta"]
    assert (by_name["size"], by_name["mime_type"], by_name["detected_by"]) == (3, "image/png", "file extension")
    assert (got["noext"]["meta"]["mime_type"], got["noext"]["meta"]["detected_by"]) == ("application/octet-stream", "fallback")
    assert got["letter.gif"]["kind"] == "text"


def test_oversize_files_name_their_type_and_limit(spark, files_of):
    body = b"PK\x03\x04" + bytes(30)
    got = _classify(spark, files_of, {"bundle.zip": body, "fits.txt": b"x" * 16}, max_size=16)
    row = got["bundle.zip"]
    assert (row["kind"], row["limit"]) == ("too_large", 16) and got["fits.txt"]["kind"] == "text"
    assert row["shown"].startswith("[File too large; MIME: application/zip; detected by: content signature; size: 34 bytes")
    assert row["shown"].endswith("; limit: 16 bytes]")


def test_control_bytes(spark, files_of):
    got = _classify(spark, files_of, {
        "two.txt": b"a\x01b\x02c",
        "three_in_300.txt": b"\x01\x02\x03" + b"a" * 297,
        "three_in_299.txt": b"\x01\x02\x03" + b"a" * 296,
        "formfeed.txt": b"\x0c\x0c\x0c" + b"a",
        "late_nul.txt": b"a" * 8192 + b"\x00",
        "early_nul.txt": b"ab\x00",
    })
    assert got["two.txt"]["kind"] == "text"
    assert got["three_in_300.txt"]["kind"] == "text"
    assert got["three_in_299.txt"]["kind"] == "binary"
    assert got["formfeed.txt"]["kind"] == "text"
    assert got["late_nul.txt"]["kind"] == "text"
    assert got["early_nul.txt"]["kind"] == "binary"


def test_utf16_edges(spark, files_of):
    got = _classify(spark, files_of, {
        "be.txt": b"\xfe\xff" + "hé".encode("utf-16-be"),
        "odd.txt": b"\xff\xfe" + "hi".encode("utf-16-le") + b"x",
        "lone.txt": b"\xff\xfeH\x00\x3d\xd8i\x00",
        "bom8.txt": b"\xef\xbb\xbfhi",
        "bad8.txt": b"a\xffb",
    })
    assert got["be.txt"]["text"] == "hé"
    assert got["odd.txt"]["kind"] == "binary"
    assert got["lone.txt"]["kind"] == "binary"
    assert got["bom8.txt"]["text"] == "﻿hi"
    assert got["bad8.txt"]["kind"] == "binary"


def test_multi_part_and_offset_signatures(spark, files_of):
    got = _classify(spark, files_of, {
        "a.webp.x": b"RIFF\x10\x00\x00\x00WEBPVP8 ",
        "b.wav.x": b"RIFF\x10\x00\x00\x00WAVEfmt ",
        "c.tar.x": b"\x00" * 257 + b"ustar\x0000",
        "d.zip.x": b"PK\x03\x04\x14\x00",
        "e.mp4.x": b"\x00\x00\x00\x18ftypisom\x00\x00",
        "f.rtf.x": b"{\\rtf1 plain",
    })
    assert got["a.webp.x"]["meta"]["mime_type"] == "image/webp"
    assert got["b.wav.x"]["meta"]["mime_type"] == "audio/x-wav"
    assert got["c.tar.x"]["meta"]["mime_type"] == "application/x-tar"
    assert got["d.zip.x"]["meta"]["mime_type"] == "application/zip"
    assert got["e.mp4.x"]["meta"]["mime_type"] == "video/mp4"
    assert got["f.rtf.x"]["kind"] == "text"
