"""FITS units written by hand."""

from __future__ import annotations

import struct

from tessella.sources import fits, registry


def card(key, value):
    return f"{key:<8}= {value:>20}".ljust(80)


def padded(data, fill):
    return data + fill * (-len(data) % 2880)


def unit(cards, data):
    return padded(("".join(cards) + "END".ljust(80)).encode(), b" ") + padded(data, b"\0")


def sample():
    image = unit([card("SIMPLE", "T"), card("BITPIX", 16), card("NAXIS", 2), card("NAXIS1", 3), card("NAXIS2", 2), card("BLANK", -1)], struct.pack(">6h", 1, 2, 3, 4, -1, 6))
    rows = struct.pack(">h4sdB", -32768, b"ab", 1.5, 7) + struct.pack(">h4sdB", 0, b"", float("nan"), 255)
    cards = [card("XTENSION", "'BINTABLE'"), card("BITPIX", 8), card("NAXIS", 2), card("NAXIS1", 15), card("NAXIS2", 2), card("PCOUNT", 0), card("GCOUNT", 1), card("TFIELDS", 4)]
    cards += [card("TTYPE1", "'U16'"), card("TFORM1", "'I'"), card("TZERO1", 32768), card("TTYPE2", "'NAME'"), card("TFORM2", "'4A'"), card("TTYPE3", "'V'"), card("TFORM3", "'D'"), card("TTYPE4", "'B'"), card("TFORM4", "'B'"), card("TNULL4", 255)]
    return image + unit(cards, rows)


def test_units_of_a_file(spark, tmp_path):
    p = tmp_path / "a.fits"
    p.write_bytes(sample())
    assert [tuple(r) for r in registry.read(spark, str(p)).collect()] == [(0, "ab", 1.5, 7), (32768, None, None, None)]
    cells = {(r["x"], r["y"]): r["v"] for r in fits.read_image(spark, str(p)).collect()}
    assert cells == {(1, 1): 1.0, (2, 1): 2.0, (3, 1): 3.0, (1, 2): 4.0, (2, 2): None, (3, 2): 6.0}
    keys = {(r["hdu"], r["key"]): r["value"] for r in fits.headers(spark, str(p)).collect()}
    assert keys[0, "BITPIX"] == "16" and keys[1, "TTYPE2"] == "NAME"


def test_text_tables(spark, tmp_path):
    cards = [card("XTENSION", "'TABLE   '"), card("BITPIX", 8), card("NAXIS", 2), card("NAXIS1", 20), card("NAXIS2", 3), card("PCOUNT", 0), card("GCOUNT", 1), card("TFIELDS", 3)]
    cards += [card("TTYPE1", "'ID'"), card("TFORM1", "'I4'"), card("TBCOL1", 1), card("TNULL1", "'-99'"), card("TTYPE2", "'V'"), card("TFORM2", "'E9.2'"), card("TBCOL2", 5), card("TTYPE3", "'T'"), card("TFORM3", "'A6'"), card("TBCOL3", 15)]
    rows = b"   7 1.50D+01 ab    " + b" -99-2.25E+00        " + b"  12          x y   "
    p = tmp_path / "t.fits"
    p.write_bytes(unit([card("SIMPLE", "T"), card("BITPIX", 8), card("NAXIS", 0)], b"") + unit(cards, rows[:20] + rows[20:40] + rows[-20:]))
    assert [tuple(r) for r in fits.read_table(spark, str(p)).collect()] == [(7, 15.0, "ab"), (None, -2.25, None), (12, None, "x y")]


def test_large_units_are_read_by_ranges_and_columns(spark, tmp_path, monkeypatch):
    d = spark.range(1000).selectExpr("id", "double(id) / 2 v", "concat('n', id) t").coalesce(1)
    fits.write_table(d, f"{tmp_path}/t")
    monkeypatch.setattr(fits, "RANGE", 700)
    back = fits.read_table(spark, f"{tmp_path}/t", columns=["t", "v"])
    assert back.columns == ["t", "v"] and back.rdd.getNumPartitions() > 20
    assert {(r["t"], r["v"]) for r in back.collect()} == {(f"n{k}", k / 2) for k in range(1000)}
    cells = spark.range(600).selectExpr("cast(id % 20 + 1 as int) x", "cast(floor(id / 20) + 1 as int) y", "cast(id as double) v")
    fits.write_image(cells, f"{tmp_path}/i")
    image = fits.read_image(spark, f"{tmp_path}/i")
    assert image.rdd.getNumPartitions() == 8
    assert {(r["x"], r["y"], r["v"]) for r in image.collect()} == {(k % 20 + 1, k // 20 + 1, float(k)) for k in range(600)}
    fits.keep_units(spark, f"{tmp_path}/t", f"{tmp_path}/k", [0, 1])
    assert {r["id"] for r in fits.read_table(spark, f"{tmp_path}/k", columns=["id"]).collect()} == set(range(1000))


def test_a_header_is_read_by_its_data_alone(spark, tmp_path):
    """A unit of 3 GB, of which only the headers and the last rows are there."""
    p = tmp_path / "big.fits"
    n = 3 * 10**9 // 8
    cards = [card("XTENSION", "'BINTABLE'"), card("BITPIX", 8), card("NAXIS", 2), card("NAXIS1", 8), card("NAXIS2", n), card("PCOUNT", 0), card("GCOUNT", 1), card("TFIELDS", 1), card("TTYPE1", "'V'"), card("TFORM1", "'D'")]
    with open(p, "wb") as f:
        f.write(unit([card("SIMPLE", "T"), card("BITPIX", 8), card("NAXIS", 0)], b"") + unit(cards, b""))
        f.seek(-(-(f.tell() + 8 * n) // 2880) * 2880)
        f.write(unit([card("XTENSION", "'IMAGE'"), card("BITPIX", 8), card("NAXIS", 0)], b""))
    assert {(r["hdu"], r["value"]) for r in fits.headers(spark, str(p)).where("key = 'XTENSION'").collect()} == {(1, "BINTABLE"), (2, "IMAGE")}
    assert fits.read_table(spark, str(p)).rdd.getNumPartitions() == -(-8 * n // fits.RANGE)
