"""Font files: characters, names, licences and shaping features, read from the bytes of TrueType and OpenType files and collections."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The Arabic blocks, the letters that Persian adds, the letters every Arabic font has, and the features that join letters.
ARABIC_RANGES = ((0x0600, 0x06FF), (0x0750, 0x077F), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF))
PERSIAN_PROBE = "پچژگکیۃ۰۱۲۳۴۵۶۷۸۹"
CORE, PERSIAN_ONLY = "ابتنم", "پچژکگی۰"
SHAPING = ("init", "medi", "fina", "isol", "rlig", "rclt", "calt", "liga", "mark", "mkmk")
FACES = "path string, face_no int, family string, coverage int, probe int, core int, persian_only int, zwnj boolean, presentation_forms int, features string, license_text string, units int, bytes bigint, error string"


def _tables(data: bytes, at: int) -> dict[str, bytes]:
    (count,) = struct.unpack_from(">H", data, at + 4)
    out = {}
    for i in range(count):
        tag, _, offset, length = struct.unpack_from(">4sIII", data, at + 12 + 16 * i)
        out[tag.decode("latin-1")] = data[offset : offset + length]
    return out


def faces(data: bytes) -> list[dict[str, bytes]]:
    """The tables of each face of a file: one, or as many as a collection has."""
    if data[:4] == b"ttcf":
        (n,) = struct.unpack_from(">I", data, 8)
        return [_tables(data, o) for o in struct.unpack_from(f">{n}I", data, 12)]
    if data[:4] not in (b"\x00\x01\x00\x00", b"OTTO", b"true"):
        raise ValueError("not a font file")
    return [_tables(data, 0)]


def code_points(cmap: bytes) -> set[int]:
    """All characters of all subtables of the formats 0, 4, 6 and 12."""
    out: set[int] = set()
    (count,) = struct.unpack_from(">H", cmap, 2)
    for i in range(count):
        _, _, at = struct.unpack_from(">HHI", cmap, 4 + 8 * i)
        (kind,) = struct.unpack_from(">H", cmap, at)
        if kind == 0:
            out |= {c for c in range(256) if cmap[at + 6 + c]}
        elif kind == 4:
            (twice,) = struct.unpack_from(">H", cmap, at + 6)
            n = twice // 2
            ends = struct.unpack_from(f">{n}H", cmap, at + 14)
            starts = struct.unpack_from(f">{n}H", cmap, at + 16 + twice)
            deltas = struct.unpack_from(f">{n}H", cmap, at + 16 + 2 * twice)
            where = at + 16 + 3 * twice
            ranges = struct.unpack_from(f">{n}H", cmap, where)
            for k, (a, b, delta, r) in enumerate(zip(starts, ends, deltas, ranges)):
                for c in range(a, min(b, 0xFFFE) + 1):
                    spot = where + 2 * k + r + 2 * (c - a)
                    glyph = (c + delta) & 0xFFFF if not r else struct.unpack_from(">H", cmap, spot)[0] if spot + 2 <= len(cmap) else 0
                    if glyph:
                        out.add(c)
        elif kind == 6:
            first, n = struct.unpack_from(">HH", cmap, at + 6)
            out |= {first + k for k, g in enumerate(struct.unpack_from(f">{n}H", cmap, at + 10)) if g}
        elif kind == 12:
            (n,) = struct.unpack_from(">I", cmap, at + 12)
            for k in range(n):
                a, b, _ = struct.unpack_from(">III", cmap, at + 16 + 12 * k)
                out |= set(range(a, min(b, 0x10FFFF) + 1))
    return out


def names(table: bytes) -> list[tuple[int, str]]:
    """(name id, text) of the name records, in the file's order."""
    _, count, strings = struct.unpack_from(">HHH", table, 0)
    out = []
    for i in range(count):
        platform, _, _, ident, length, offset = struct.unpack_from(">6H", table, 6 + 12 * i)
        raw = table[strings + offset : strings + offset + length]
        out.append((ident, raw.decode("mac_roman" if platform == 1 else "utf-16-be", "ignore").strip()))
    return out


def features(gsub: bytes) -> set[str]:
    """The tags in the feature list that have to do with joining letters."""
    (at,) = struct.unpack_from(">H", gsub, 6)
    (count,) = struct.unpack_from(">H", gsub, at)
    return {gsub[at + 2 + 6 * i : at + 6 + 6 * i].decode("latin-1") for i in range(count)} & set(SHAPING)


def described(path: str, data: bytes) -> list[tuple]:
    """A row of FACES per face; a file that can't be read gives one row with its error."""
    stem = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    rows: list[tuple] = []
    try:
        for i, t in enumerate(faces(data)):
            points = code_points(t["cmap"])
            known = names(t["name"]) if "name" in t else []
            family = next((v for k, v in known if k in (16, 1) and v), stem)
            licence = " ".join(v for k, v in known if k in (13, 14)) or None
            coverage = sum(c in points for a, b in ARABIC_RANGES for c in range(a, b + 1))
            forms = sum(c in points for a, b in ARABIC_RANGES[2:] for c in range(a, b + 1))
            units = struct.unpack_from(">H", t["head"], 18)[0] if "head" in t else None
            shaping = ",".join(sorted(features(t["GSUB"]))) if len(t.get("GSUB", b"")) > 8 else ""
            count = lambda letters: sum(ord(c) in points for c in letters)
            rows.append((path, i, family, coverage, count(PERSIAN_PROBE), count(CORE), count(PERSIAN_ONLY), 0x200C in points, forms, shaping, licence, units, len(data), None))
    except (struct.error, ValueError, KeyError, IndexError) as e:
        rows = [(path, None, stem, 0, 0, 0, 0, False, 0, "", None, None, len(data), str(e) or type(e).__name__)]
    return rows


def font_faces(files: DataFrame) -> DataFrame:
    """One row per face of the files (path, content): each file is read once, by one task."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in FACES.split(", ")]
        for pdf in batches:
            yield pd.DataFrame([r for p, c in zip(pdf["path"], pdf["content"]) for r in described(p, bytes(c))], columns=columns).astype({"face_no": "Int32", "units": "Int32"})

    return files.select("path", "content").mapInPandas(work, FACES)


def written(points: list[int], records: list[tuple[int, str]], tags: tuple[str, ...] = ()) -> bytes:
    """The smallest file that these readers take for a font: characters, name records and feature tags, without outlines. For fixtures."""
    chars = sorted(points)
    groups = [(a, i) for i, a in enumerate(chars, 1)]
    cmap = struct.pack(">HHHHIHHIII", 0, 1, 3, 10, 12, 12, 0, 16 + 12 * len(groups), 0, len(groups)) + b"".join(struct.pack(">III", a, a, g) for a, g in groups)
    texts = [(ident, text.encode("utf-16-be")) for ident, text in records]
    starts = [sum(len(t) for _, t in texts[:i]) for i in range(len(texts))]
    name = struct.pack(">HHH", 0, len(texts), 6 + 12 * len(texts)) + b"".join(struct.pack(">6H", 3, 1, 0x409, k, len(t), at) for (k, t), at in zip(texts, starts)) + b"".join(t for _, t in texts)
    gsub = struct.pack(">6H", 1, 0, 0, 10, 0, len(tags)) + b"".join(t.encode() + b"\0\0" for t in tags)
    tables = {"GSUB": gsub, "cmap": cmap, "head": bytes(18) + struct.pack(">H", 1000) + bytes(34), "name": name}
    out, at = b"\0\1\0\0" + struct.pack(">4H", len(tables), 0, 0, 0), 12 + 16 * len(tables)
    for tag, data in tables.items():
        out += struct.pack(">4sIII", tag.encode(), 0, at, len(data))
        at += len(data)
    return out + b"".join(tables.values())


def font_table(faces_: DataFrame) -> DataFrame:
    """path, family, coverage, probe, license_text: the face of each file with the most probe letters, then the widest."""
    best = faces_.groupBy("path").agg(F.max_by(F.struct("coverage", "probe"), F.struct("probe", "coverage")).alias("b"), F.min_by("family", F.coalesce("face_no", F.lit(0))).alias("family"), F.array_join(F.collect_list("license_text"), " ").alias("licence"), F.count("license_text").alias("known"), F.count("*").alias("n"))
    licence = F.when(F.col("known") == F.col("n"), F.col("licence"))  # every face has to say so
    return best.select("path", "family", "b.coverage", "b.probe", licence.alias("license_text"))


def audited(faces_: DataFrame) -> DataFrame:
    """The faces with any Arabic letter and a verdict: GOOD, GOOD* (no non-joiner), ARABIC (letters missing), LEGACY (presentation forms only), BROKEN (letters don't join)."""
    shaped = F.col("features").rlike("init|medi|fina")
    persian = F.col("persian_only") >= 5
    verdict = F.when((F.col("presentation_forms") > 40) & ~shaped, "LEGACY").when(shaped & persian & F.col("zwnj"), "GOOD").when(shaped & persian, "GOOD*").when(shaped, "ARABIC").otherwise("BROKEN")
    return faces_.where("error is null and (core > 0 or persian_only > 0)").withColumn("verdict", verdict)
