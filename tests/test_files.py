"""The file sources: pieces, headers, marked lines, against whole files."""

import io
import random

import pytest

from millrace.sources import files, nodelogs, runlogs


@pytest.mark.parametrize("block", [3, 7, 1 << 20])
def test_pieces_hold_every_line_once(monkeypatch, block):
    monkeypatch.setattr(files, "BLOCK_BYTES", block)
    rng = random.Random(block)
    for _ in range(200):
        lines = ["x" * rng.choice([0, 1, 2, 5, 40]) + str(i) for i in range(rng.randint(0, 12))]
        data = ("\n".join(lines) + rng.choice(["", "\n"])).encode()
        cuts = sorted({0, len(data), *(rng.randint(0, len(data)) for _ in range(rng.randint(0, 6)))})
        found = []
        for begin, end in zip(cuts, cuts[1:]):
            for at, piece in files.blocks_of(io.BytesIO(data), begin, end):
                assert data[at : at + len(piece)] == piece and (at == 0 or data[at - 1 : at] == b"\n")
                found.append(piece)
        assert b"".join(found) == data


def test_small_files_together_and_large_ones_cut():
    size = 4 << 20
    found = files.cut_pieces([("a", 10), ("b", 0), ("c", 2 * size + 5), ("d", 1)], size)
    assert [p.parts for p in found] == [
        [("a", 0, 10), ("b", 0, 0)], [("c", 0, size)], [("c", size, 2 * size)], [("c", 2 * size, 2 * size + 5), ("d", 0, 1)]]
    assert files.cut_pieces([], 5) == []


def test_listing(tmp_path):
    for name in ("metrics_a.csv", "metrics_b c%.csv", "other.csv", "_hidden", ".x"):
        (tmp_path / name).write_text("x")
    names = lambda path, *more: [p.rsplit("/", 1)[-1] for p, _ in files.list_files(path, *more)]
    folder = str(tmp_path)
    assert names(folder, "metrics_*.csv") == names("file://" + folder + "/", "metrics_*.csv") == ["metrics_a.csv", "metrics_b c%.csv"]
    assert names(folder) == ["metrics_a.csv", "metrics_b c%.csv", "other.csv"]
    assert names(folder + "/m*.csv") == ["metrics_a.csv", "metrics_b c%.csv"] and names(folder + "/other.csv") == ["other.csv"]
    assert files.exists(folder) and not files.exists(folder + "/none") and files.exists("file:" + folder)
    assert files.opens(folder) and not files.opens("viewfs://in/x")


def _metrics(seed, rows):
    rng = random.Random(seed)
    names = ["ts", "cpu_util_pct", "more", "mem_used_mb", "devices"]
    rng.shuffle(names)
    lines = [",".join(names)]
    for i in range(rows):
        cells = {"ts": f"{1000 + i}.5", "cpu_util_pct": f" {i} ", "more": '"a,b"', "mem_used_mb": "", "devices": "sda;sdb"}
        lines.append(",".join(cells[n] for n in names))
        lines += [rng.choice(["", "  ", ",".join(names)])] * (rng.random() < 0.1)
    return "\r\n".join(lines) + "\n"


@pytest.mark.parametrize("piece", [64 << 20, 500])
def test_rows_by_header_equal_the_reader_of_spark(spark, write, monkeypatch, piece):
    monkeypatch.setattr(files, "PIECE_BYTES", piece)
    folder = write("m/metrics_a.csv", _metrics(1, 200)).rsplit("/", 1)[0]
    write("m/metrics_b x%41+.csv", _metrics(2, 30))
    write("m/metrics_empty.csv", "")
    write("m/metrics_head.csv", "ts,hostname\n")
    write("m/none.csv", "ts\n5\n")
    ours = nodelogs.read_node_metrics(spark, folder)
    theirs = nodelogs._by_spark(spark, folder).replace("", None)
    assert ours.schema.simpleString() == theirs.schema.simpleString()
    assert sorted(map(str, ours.collect())) == sorted(map(str, theirs.collect())) and ours.count() == 230
    names = {r.node for r in nodelogs.read_node_names(spark, folder).collect()}
    assert names == {"a", "b x%41+", "empty", "head"}


@pytest.mark.parametrize("piece", [64 << 20, 300])
def test_first_marked_lines_equal_the_reader_of_spark(spark, write, monkeypatch, piece):
    monkeypatch.setattr(files, "PIECE_BYTES", piece)
    mark = runlogs.RESULT_MARKER
    first = "\n".join(["noise"] * 100 + [f"x {mark}{{}}", f'  {mark}{{"run_id": "a"}}', f'{mark}{{"run_id": "b"}}'])
    folder = write("l/a.log", first).rsplit("/", 1)[0]
    write("l/b.log", f"{mark}broken\n{mark}{{}}\r\n")
    write("l/c.log", "nothing\n")
    write("l/d.log", "")
    ours, theirs = runlogs.read_results(spark, folder), runlogs._found_by_spark(spark, folder)
    payloads = {r.path.rsplit("/", 1)[-1]: r.payload for r in ours.collect()}
    assert payloads == {"a.log": '{"run_id": "a"}', "b.log": "broken", "c.log": None, "d.log": None}
    assert {(r.path, r.payload) for r in ours.collect()} == {(r.path, r.payload) for r in theirs.collect()}
    assert runlogs.read_results(spark, folder + "-none").collect() == []
