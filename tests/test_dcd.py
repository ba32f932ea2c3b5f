"""The DCD source against written bytes: ranges, chosen frames, both cell sizes, a fourth dimension, damage."""

import struct

import numpy as np
import pytest

from seriata.sources import coordinates, dcd


def record(payload, order="<"):
    mark = struct.pack(order + "i", len(payload))
    return mark + payload + mark


def file_of(frames, cells=None, cell="6d", fourth=False, extended=True, order="<"):
    control = [len(frames), 0, 1, *[0] * 7, int(cells is not None), int(fourth), *[0] * 7, 24 if extended else 0]
    out = record(b"CORD" + struct.pack(order + "20i", *control), order) + record(struct.pack(order + "i", 1) + b" " * 80, order) + record(struct.pack(order + "i", frames.shape[1]), order)
    for k, f in enumerate(frames):
        if cells is not None:
            a, b, c, alpha, beta, gamma = cells[k]
            out += record(struct.pack(order + cell, a, gamma, b, beta, alpha, c), order)
        axes = [f[:, i] for i in range(3)] + ([np.zeros(len(f))] if fourth else [])
        out += b"".join(record(x.astype(order + "f4").tobytes(), order) for x in axes)
    return out


FRAMES = np.round(np.random.default_rng(3).normal(0, 5, (9, 4, 3)), 3).astype("f4")
CELLS = [(10.0 + k, 11.0, 12.0, 90.0, 80.0, 70.0) for k in range(9)]


@pytest.mark.parametrize("options", [{}, {"cells": CELLS}, {"cells": CELLS, "cell": "6f"}, {"cells": CELLS, "fourth": True, "order": ">"}])
def test_frames_in_ranges(spark, tmp_path, options):
    (tmp_path / "a.dcd").write_bytes(file_of(FRAMES, **options))
    (tmp_path / "b.dcd").write_bytes(file_of(FRAMES[:2], **({**options, "cells": CELLS[:2]} if "cells" in options else options)))
    df = dcd.read_dcd(spark, f"file://{tmp_path}", range_bytes=200)
    assert df.rdd.getNumPartitions() > 2
    got = {(r.path[-5:], r.frame): r for r in df.collect()}
    assert set(got) == {("a.dcd", k) for k in range(9)} | {("b.dcd", k) for k in range(2)}
    for (name, k), r in got.items():
        assert np.allclose(np.array(r.points), FRAMES[k]) and (r.cell is None) == ("cells" not in options), name
        assert r.cell is None or np.allclose(r.cell, CELLS[k])


def test_options_choose_what_is_read(spark, tmp_path):
    data = bytearray(file_of(FRAMES))
    data[-40:-20] = b"\xff" * 20  # the last frame is damaged, and must not be read
    (tmp_path / "a.dcd").write_bytes(bytes(data))
    told = lambda **options: [r.frame for r in dcd.read_dcd(spark, str(tmp_path), **options).orderBy("frame").collect()]
    assert told(start=2, end=5) == [2, 3, 4] and told(frames=[1, 6, 99]) == [1, 6] and told(frames=[6, 7], start=7) == [7] and told(frames=[]) == told(start=9) == []
    with pytest.raises(Exception, match="markers disagree"):
        told()


def test_words_of_other_writers_do_not_count(spark, tmp_path):
    """Without the mark of extensions, a set word 11 is no cell."""
    data = bytearray(file_of(FRAMES, extended=False))
    data[8 + 40 : 8 + 44] = struct.pack("<i", 7)
    (tmp_path / "a.dcd").write_bytes(bytes(data))
    assert dcd.read_dcd(spark, str(tmp_path)).count() == 9


def test_cut_files_fail(spark, tmp_path):
    (tmp_path / "a.dcd").write_bytes(file_of(FRAMES)[:-5])
    with pytest.raises(Exception, match="cut short"):
        dcd.read_dcd(spark, str(tmp_path)).count()
    (tmp_path / "a.dcd").write_bytes(b"nothing")
    with pytest.raises(Exception, match="not a DCD"):
        dcd.read_dcd(spark, str(tmp_path)).count()


def test_writing_holds_one_batch_and_grows_with_its_frames(tmp_path):
    """Frames go to the file batch by batch: ten times as many take no more memory."""
    import tracemalloc

    peaks = []
    for n in (20, 200):
        batches = (np.full((100, 21, 3), k, "f4") for k in range(n))
        tracemalloc.start()
        assert coordinates.append_dcd(f"{tmp_path}/{n}.dcd", batches, 21) == 100 * n
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 2 * peaks[0]
    data = (tmp_path / "20.dcd").read_bytes()
    assert data == coordinates.write_dcd(np.concatenate([np.full((100, 21, 3), k, "f4") for k in range(20)])) and not list(tmp_path.glob("*.dcd.*"))
    assert coordinates.append_dcd(f"{tmp_path}/none.dcd", iter([]), 21) == 0


def test_written_bytes_are_joined_once():
    """Ten times the frames take about ten times as long, not a hundred times."""
    import time

    def seconds(n):
        frames, best = np.zeros((n, 21, 3)), 1e9
        for _ in range(3):
            began = time.perf_counter()
            coordinates.write_dcd(frames)
            best = min(best, time.perf_counter() - began)
        return best

    assert seconds(30_000) < 30 * seconds(3_000)
    cells = [(10.0 + k, 11.0, 12.0, 90.0, 80.0, 70.0) for k in range(9)]
    assert coordinates.write_dcd(FRAMES, cells) == file_of(FRAMES, cells)
