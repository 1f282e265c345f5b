"""Font files made by hand: characters, names, features, collections, verdicts."""

import struct

from varaq.operators import fonts as FT
from varaq.sources import sfnt


def cmap4(points):
    segs = [(c, c) for c in sorted(points)] + [(0xFFFF, 0xFFFF)]
    n = len(segs)
    body = struct.pack(">4H", 2 * n, 0, 0, 0) + struct.pack(f">{n}H", *(b for _, b in segs)) + b"\0\0" + struct.pack(f">{n}H", *(a for a, _ in segs)) + struct.pack(f">{n}H", *(((1 - a) & 0xFFFF) for a, _ in segs)) + struct.pack(f">{n}H", *([0] * n))
    sub = struct.pack(">3H", 4, 6 + len(body), 0) + body
    return struct.pack(">HHHHI", 0, 1, 3, 1, 12) + sub


def name_table(records):
    data, rows = b"", b""
    for ident, text in records:
        raw = text.encode("utf-16-be")
        rows += struct.pack(">6H", 3, 1, 0x409, ident, len(raw), len(data))
        data += raw
    return struct.pack(">HHH", 0, len(records), 6 + len(rows)) + rows + data


def gsub(tags):
    return struct.pack(">HHHHH", 1, 0, 0, 10, 0) + struct.pack(">H", len(tags)) + b"".join(t.encode() + b"\0\0" for t in tags)


def font(points, records, tags=(), base=0):
    tables = {"cmap": cmap4(points), "name": name_table(records), "head": b"\0" * 18 + struct.pack(">H", 1000) + b"\0" * 34, "GSUB": gsub(tags)}
    at, head, body = base + 12 + 16 * len(tables), b"\0\1\0\0" + struct.pack(">4H", len(tables), 0, 0, 0), b""
    for k, v in tables.items():
        head += k.encode() + struct.pack(">III", 0, at + len(body), len(v))
        body += v
    return head + body


PERSIAN = [ord(c) for c in sfnt.PERSIAN_PROBE + sfnt.CORE + "‌"]


def test_faces(spark):
    good = font(PERSIAN, [(1, "Good"), (13, "SIL Open Font License")], ("init", "fina", "kern"))
    legacy = font([*range(0xFB50, 0xFB90), ord("ب")], [(1, "Old")])
    first = font([ord("ب")], [(16, "One")], base=20)
    both = b"ttcf" + struct.pack(">IIII", 0x10000, 2, 20, 20 + len(first)) + first + font(PERSIAN, [(1, "Two")], base=20 + len(first))
    rows = spark.createDataFrame([("/f/good.ttf", good), ("/f/old.ttf", legacy), ("/f/both.ttc", both), ("/f/bad.ttf", b"nothing")], "path string, content binary")
    faces = sfnt.font_faces(rows)
    got = {(r["path"], r["face_no"]): r for r in faces.collect()}
    assert got["/f/good.ttf", 0]["family"] == "Good" and got["/f/good.ttf", 0]["probe"] == 17 and got["/f/good.ttf", 0]["features"] == "fina,init" and got["/f/good.ttf", 0]["units"] == 1000
    assert got["/f/bad.ttf", None]["error"] and got["/f/both.ttc", 1]["family"] == "Two"
    table = {r["path"]: r for r in sfnt.font_table(faces).collect()}
    assert table["/f/both.ttc"]["family"] == "One" and table["/f/both.ttc"]["probe"] == 17 and table["/f/bad.ttf"]["coverage"] == 0
    verdicts = {(r["path"], r["face_no"]): r["verdict"] for r in sfnt.audited(faces).collect()}
    assert verdicts == {("/f/good.ttf", 0): "GOOD", ("/f/old.ttf", 0): "LEGACY", ("/f/both.ttc", 0): "BROKEN", ("/f/both.ttc", 1): "BROKEN"}
    fam = FT.families(sfnt.font_table(faces)).collect()
    assert {r["family"]: r["redistributable"] for r in fam} == {"Old": False}  # only it has forty letters


def test_cmap_formats():
    six = struct.pack(">HHHHI", 0, 1, 1, 0, 12) + struct.pack(">HHHHH", 6, 16, 0, 65, 3) + struct.pack(">3H", 1, 0, 2)
    twelve = struct.pack(">HHHHI", 0, 1, 3, 10, 12) + struct.pack(">HHIII", 12, 0, 28, 0, 1) + struct.pack(">III", 0x10FC00, 0x10FC02, 1)
    zero = struct.pack(">HHHHI", 0, 1, 1, 0, 12) + struct.pack(">HHH", 0, 262, 0) + bytes([0] * 65 + [1] + [0] * 190)
    assert sfnt.code_points(six) == {65, 67} and sfnt.code_points(twelve) == {0x10FC00, 0x10FC01, 0x10FC02} and sfnt.code_points(zero) == {65}
