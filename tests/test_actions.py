"""Actions from files to files."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright import actions
from tilewright.functions import colour, grid
from tilewright.operators import blocks
from tilewright.sources import containers

N, LEVEL, TX, TY = 32, 12, 1240, 1640


def edges(tx, ty):
    lon = lambda x: (2 * x / 2**LEVEL - 1) * 180
    lat = lambda y: 180 / grid.K * math.atan(grid.K * (2 * y / 2**LEVEL - 1))
    return lon(tx), lon(tx + 1), lat(ty), lat(ty + 1)


def job(tmp_path, images):
    """Images that cover the square of level 11 above (TX, TY), written with their georeferences; a job of levels 11 and 12."""
    w, _, s, _ = edges(TX, TY)
    _, e, _, n = edges(TX + 1, TY + 1)
    for name, rgb, (x0, x1) in images:
        step_x, step_y = (x1 - x0) * (e - w) / rgb.shape[1], -(n - s) / rgb.shape[0]
        (tmp_path / "img").mkdir(exist_ok=True)
        (tmp_path / "aid").mkdir(exist_ok=True)
        (tmp_path / "img" / name).write_bytes(blocks.png(rgb))
        (tmp_path / "aid" / f"{name}.aid").write_text(f"<[file][][]\n<[tm_aerial_image_definition][][]\n<[string8][image][{name}]>\n<[bool][flip_vertical][false]>\n<[vector2_float64][steps_per_pixel][{step_x:.15f} {step_y:.15f}]>\n<[vector2_float64][top_left][{w + x0 * (e - w):.15f} {n:.15f}]>\n>>\n")
    d = 1e-6
    region = lambda level: f"<[region][element][0]<[int][level][{level}]><[vector2_float64][lonlat_min][{w + d:.12f} {n - d:.12f}]><[vector2_float64][lonlat_max][{e - d:.12f} {s + d:.12f}]>>"
    (tmp_path / "job.tmc").write_text("<[file][][]<[tm_config][aerial_images][]\n<[list][region_list][]\n" + region(11) + "\n" + region(12) + "\n>>>\n")
    return w, e, s, n


def run(spark, tmp_path, **options):
    out = tmp_path / "out"
    rows = actions.convert_job(spark, str(tmp_path / "job.tmc"), str(tmp_path / "img"), str(tmp_path / "aid"), str(out), N, **options).collect()
    assert {r["name"]: r["bytes"] for r in rows} == {p.name: p.stat().st_size for p in out.iterdir()}
    return {p.name: containers.parse_texture(p.read_bytes()) for p in out.iterdir()}


def test_convert(spark, tmp_path):
    rng = np.random.default_rng(2)
    first, second = (rng.integers(0, 256, (300, 300, 3)).astype(np.uint8) for _ in range(2))
    w, e, s, n = job(tmp_path, [("a.png", first[:, :150], (0.0, 0.5)), ("B.png", second, (0.0, 1.0))])
    got = run(spark, tmp_path, linear=True)
    name = lambda level, x, y: f"map_{level:02d}_{x << 16 - level:04x}_{y << 16 - level:04x}"
    assert set(got) == {f"{name(11, TX // 2, TY // 2)}.ttc", *(f"{name(12, TX + i, TY + j)}.ttc" for i in (0, 1) for j in (0, 1))}
    tone, pixels = np.array(colour.curve(), np.uint8), {}
    for i in (0, 1):
        for j in (0, 1):
            lon = (2 * (TX + i + (np.arange(N) + 0.5) / N) / 2**LEVEL - 1) * 180
            lat = np.array([180 / grid.K * math.atan(grid.K * (2 * (TY + j + 1 - (k + 0.5) / N) / 2**LEVEL - 1)) for k in range(N)])
            source, width = (first[:, :150], 0.5) if i == 0 else (second, 1.0)
            c, r = np.floor((lon - w) / ((e - w) * width / source.shape[1])).astype(int), np.floor((n - lat) / ((n - s) / 300)).astype(int)
            pixels[i, j] = tone[source[np.ix_(r, c)]]
            t = got[f"{name(12, TX + i, TY + j)}.ttc"]
            assert (t["kind"], t["level"], t["width"]) == (containers.DXT1, 12, N)
            assert t["payload"] == blocks.mip_chain(pixels[i, j][::-1])
    whole = np.concatenate([np.concatenate([pixels[0, j], pixels[1, j]], 1) for j in (1, 0)])
    assert got[f"{name(11, TX // 2, TY // 2)}.ttc"]["payload"] == blocks.mip_chain(blocks.halve(whole)[::-1])


def test_convert_cuts_at_the_coast(spark, tmp_path):
    w, e, s, n = job(tmp_path, [("a.png", np.full((64, 64, 3), 90, np.uint8), (0.0, 1.0))])
    middle = (w + e) / 2
    (tmp_path / "c.txt").write_text(f"# coast\n# land E\n{s - 1} {middle}\n{n + 1} {middle}\n")
    got = run(spark, tmp_path, line_file=str(tmp_path / "c.txt"), margin_km=1.0)
    masks = {k: v for k, v in got.items() if "_mask" in k}
    assert masks and all(v["kind"] == containers.L8 and v["levels"] == 4 for v in masks.values())
    km = (e - w) / 2 * 111.32 * math.cos(math.radians((s + n) / 2))  # a tile's width
    square = masks[f"map_11_{TX // 2 << 5:04x}_{TY // 2 << 5:04x}_mask.ttc"]
    row = np.frombuffer(square["payload"], np.uint8, 64).reshape(8, 8)[0]
    sea = (km - 1.0) / (2 * km) * 8  # texels wholly past the margin
    assert (row[: int(sea) - 1] == 0).all() and (row[int(sea) + 2 :] == 255).all()


def test_convert_cuts_lakes_corrects_water_and_passes_black_on(spark, tmp_path):
    black = np.zeros((64, 64, 3), np.uint8)
    black[:, :32] = 60
    w, e, s, n = job(tmp_path, [("a.png", black, (0.0, 1.0)), ("b.png", np.full((64, 64, 3), 200, np.uint8), (0.0, 1.0))])
    q = (e - w) / 4
    (tmp_path / "lakes.txt").write_text(f"# lake 1\n{s - 1} {w - 1}\n{n + 1} {w - 1}\n{n + 1} {w + q}\n{s - 1} {w + q}\n")
    (tmp_path / "water").mkdir()
    (tmp_path / "water" / "a.awfx").write_bytes(containers.field_file(w, e, n, s, np.full((4, 4), 0.5, np.float32), np.full((4, 4, 3), 10, np.float32)))
    got = run(spark, tmp_path, linear=True, lakes_file=str(tmp_path / "lakes.txt"), water=str(tmp_path / "water"), black_is_missing=True)
    top = blocks.decode_bc1(got[f"map_11_{TX // 2 << 5:04x}_{TY // 2 << 5:04x}.ttc"]["payload"][: N * N // 2], N, N)
    tone = colour.curve()
    assert (top[:, : N // 4 - 4] == 0).all()  # in the lake
    assert np.abs(top[:, N // 4 + 4 : N // 2].astype(int) - tone[40]).max() <= 8  # 60 * 0.5 + 10, from the first
    assert np.abs(top[:, N // 2 + 4 :].astype(int) - tone[110]).max() <= 8  # black passed on to the second: 200 * 0.5 + 10
    mask = np.frombuffer(got[f"map_11_{TX // 2 << 5:04x}_{TY // 2 << 5:04x}_mask.ttc"]["payload"], np.uint8, 64).reshape(8, 8)
    assert (mask[:, 0] == 0).all() and (mask[:, 3:] == 255).all()


def test_command_line(spark, tmp_path, capsys):
    from tilewright.__main__ import main

    w, e, s, n = job(tmp_path, [("a.png", np.full((16, 16, 3), 90, np.uint8), (0.0, 1.0))])
    call = lambda *more: main(["convert", str(tmp_path / "job.tmc"), str(tmp_path / "img"), str(tmp_path / "aid"), "--out", str(tmp_path / "cli"), "--size", "16", "--linear-rows", *more])
    assert call() == 0 and "files" in capsys.readouterr().out
    (tmp_path / "far.txt").write_text(f"# coast\n# land E\n{s - 1} {e + 1}\n{n + 1} {e + 1}\n")
    assert call("--coast", str(tmp_path / "far.txt")) == 0 and "past the cut" in capsys.readouterr().out
    text = (tmp_path / "job.tmc").read_text()
    (tmp_path / "job.tmc").write_text(text.replace("<[list][region_list][]", "<[bool][write_raw_files][true]>\n<[bool][odd_one][true]>\n<[bool][do_heightmaps][true]>\n<[list][region_list][]"))
    assert call() == 1
    said = capsys.readouterr().err
    assert "note: raw files" in said and "unknown field odd_one" in said and "error: heights" in said
    with pytest.raises(SystemExit) as wrong:
        main(["convert"])
    assert wrong.value.code == 2


def test_classify(spark, tmp_path):
    names = spark.createDataFrame([(f"map_09_{x << 7:04x}_{y << 7:04x}",) for x, y in ((155, 205), (153, 205), (158, 205), (155, 190))], "name string")
    w, e, s, n = (spark.range(1).select(*[c.alias(k) for k, c in grid.square_edges(F.lit(155), F.lit(205), 9).items()]).first()[k] for k in "wesn")
    (tmp_path / "c.txt").write_text(f"# coast\n# land E\n{s - 1} {w + 0.3}\n{n + 1} {w + 0.3}\n\n# island 1\n{s} {w - 3}\n{s + 0.1} {w - 3.1}\n{s} {w - 3.2}\n")
    got = {r["name"][7:16]: r["verdict"] for r in actions.classify(spark, names, str(tmp_path / "c.txt"), texels=17).collect()}
    assert got == {"4d80_6680": "CUT", "4c80_6680": "SEA", "4f00_6680": "LAND", "4d80_5f00": "OUTSIDE"}


def test_install(spark, tmp_path):
    for folder, files in (("new", ("map_a.ttc", "map_b.ttc")), ("there", ("MAP_A.ttc", "map_c.ttc", "keep.txt"))):
        (tmp_path / folder).mkdir()
        for f in files:
            (tmp_path / folder / f).write_text(folder)
    actions.install(spark, str(tmp_path / "new"), str(tmp_path / "there"))
    assert {p.name for p in (tmp_path / "there").iterdir()} == {"MAP_A.ttc", "map_a.ttc", "map_b.ttc", "keep.txt"}


def test_job_files(spark, tmp_path):
    from tilewright.sources import text_jobs

    (tmp_path / "stale.tmc").write_text("x")
    regions = spark.createDataFrame([("sq1", 9, -71.0, -70.0, -34.0, -33.0, True), ("sq1", 12, -70.9, -70.5, -33.9, -33.5, False), ("sq2", 9, -70.0, -69.0, -34.0, -33.0, True)], "job string, level long, w double, e double, s double, n double, mask boolean")
    aids = spark.createDataFrame([("a.png", 1e-5, -1e-5, -71.0, -33.0)], "image string, step_x double, step_y double, x double, y double")
    actions.write_jobs(spark, regions, aids, str(tmp_path))
    assert {p.name for p in tmp_path.iterdir()} == {"sq1.tmc", "sq2.tmc", "a.png.aid"}
    back = text_jobs.regions(actions._text(spark, str(tmp_path / "sq1.tmc")), "file").orderBy("level").collect()
    assert [(r["level"], r["mask"]) for r in back] == [(9, True), (12, False)] and back[0]["w"] == pytest.approx(-70.99)


def test_landmarks(spark, tmp_path):
    row = lambda k, name, lat, kind, code, pop, dem: "\t".join([str(k), name, name, "", str(lat), "-70.5", kind, code, "CL", "", "", "", "", "", str(pop), "", str(dem), "tz", "d"])
    rows = [row(1, "Comuna de Paine", -33.8, "A", "ADM3", 0, 500), row(2, "Paine", -33.81, "P", "PPL", 9000, 400), row(3, "Farm", -33.0, "P", "PPL", 0, 10), row(4, "Comuna Buin", -33.7, "A", "ADM3", 5, -9999)]
    (tmp_path / "g.txt").write_text("\n".join(rows))
    got = {r["place_id"]: (r["name"], r["height"]) for r in actions.landmarks(spark, str(tmp_path / "g.txt")).collect()}
    assert got == {2: ("Paine", 450.0), 4: ("Buin", 50.0)}
