"""Growing files: new bytes only, replaced files, torn and long lines, history."""

from __future__ import annotations

import json
import os
import random

import pytest

from tests.test_state import log_lines, sample_rows
from usagelens import schemas
from usagelens.session import new_path
from usagelens.sources import logs
from usagelens.streaming import follow, growing, log_state


class Walk:
    """One file scanned again and again; the place goes through the types it is stored in."""

    def __init__(self, path):
        self.path, self.place, self.clock = path, None, 1_000_000.0

    def scan(self, first=False, age=0.0):
        self.clock += 5
        stat = os.stat(self.path)
        found = {"file": f"file:{self.path}", "size": stat.st_size, "modified": self.clock - age, "scanned_at": self.clock, "first": first}
        out, walk = [], growing._follow(found, self.place)
        while True:
            try:
                out.append(next(walk))
            except StopIteration as end:
                self.place = dict(zip(growing._FIELDS, tuple(end.value[f] for f in growing._FIELDS), strict=True))
                return [(r.generation, r.ordinal, r.live, r.value) for r in out]


@pytest.fixture
def walk(tmp_path):
    path = tmp_path / "a b.jsonl"
    path.write_bytes(b"")
    return Walk(path)


def add(walk, text):
    with open(walk.path, "ab") as f:
        f.write(text if isinstance(text, bytes) else text.encode())


def test_appended_lines_come_once_and_torn_ones_wait(walk):
    assert walk.scan() == []
    add(walk, "one\ntw")
    assert walk.scan() == [(0, 0, True, "one")]
    assert walk.scan() == []
    add(walk, "o\n\nünï")
    assert walk.scan() == [(0, 1, True, "two"), (0, 2, True, "")]
    add(walk, "c\n")
    assert walk.scan() == [(0, 3, True, "ünïc")]


@pytest.mark.parametrize("text", ["x\n", "new line one\nnew\n", "new1\nnew2\nmore\nand more\n", "old1\nOLD2\n", "old1\nOLD2\nand more\n"])
def test_replaced_files_are_read_from_their_start(walk, text):
    """Shorter, of the same length, longer; with another start or another end."""
    add(walk, "old1\nold2\n")
    assert [x[3] for x in walk.scan()] == ["old1", "old2"]
    walk.path.write_text(text)
    assert walk.scan() == [(1, k, True, line) for k, line in enumerate(text.splitlines())]
    add(walk, "later\n")
    assert walk.scan() == [(1, len(text.splitlines()), True, "later")]


def test_emptied_and_deleted_files(walk):
    add(walk, "old\n")
    walk.scan()
    walk.path.write_text("")
    assert walk.scan() == []
    add(walk, "old\n")
    assert walk.scan() == [(1, 0, True, "old")]
    place = dict(walk.place)
    gone = {"file": f"file:{walk.path}.gone", "size": 9, "modified": 1.0, "scanned_at": 2.0, "first": False}
    walk_gone = growing._follow(gone, place)
    with pytest.raises(StopIteration) as end:
        next(walk_gone)
    assert end.value.value == place


def test_long_and_unreadable_lines_have_no_value(walk, monkeypatch):
    monkeypatch.setattr(growing, "LONGEST", 50)
    monkeypatch.setattr(growing, "PIECE", 16)
    add(walk, b"a\n" + b"x" * 200)
    assert walk.scan() == [(0, 0, True, "a"), (0, 1, True, None)]
    add(walk, b"x" * 70 + b"\nb\n\xff\xfe\n" + b"y" * 50 + b"\n")
    assert walk.scan() == [(0, 2, True, "b"), (0, 3, True, None), (0, 4, True, "y" * 50)]


@pytest.mark.parametrize("start", [10, 11, 12, 40, 10_000])
def test_history_is_bounded_and_not_live(walk, monkeypatch, start):
    monkeypatch.setattr(growing, "START_BYTES", start)
    header = json.dumps({"payload": {"subagent_history_start_ordinal": 7}})
    add(walk, header + "\n" + "".join(f"line{k:02}\n" for k in range(20)))
    found = walk.scan(first=True)
    assert not any(live for _, _, live, _ in found) and found[0] == (0, 0, False, header)
    whole = start > 7 * 20 + len(header)
    kept = 20 if whole else min(20, start // 7)
    assert [v for *_, v in found[1:]] == [f"line{k:02}" for k in range(20 - kept, 20)]
    assert found[1][1] == (1 if whole else 8)
    add(walk, "new\n")
    assert walk.scan() == [(0, found[-1][1] + 1, True, "new")]


def test_old_files_are_read_when_they_change(walk):
    add(walk, "past\nhalf")
    assert walk.scan(first=True, age=1000) == [] and walk.place["waits"]
    add(walk, " done\nnew\n")
    assert walk.scan() == [(0, 0, False, "past"), (0, 1, True, "half done"), (0, 2, True, "new")]
    other = Walk(walk.path)
    other.scan(first=True, age=1000)
    walk.path.write_text("z\n")
    assert other.scan() == [(0, 0, True, "z")]


@pytest.mark.parametrize("seed", range(20))
def test_any_growth_gives_every_line_once(walk, monkeypatch, seed):
    r = random.Random(seed)
    monkeypatch.setattr(growing, "PIECE", r.choice([3, 64, 1 << 20]))
    text = "".join(r.choice(["é", "x", "\n", " "]) for _ in range(400)).encode() + b"\n"
    at, found = 0, []
    while at < len(text):
        step = r.randrange(1, 60)
        add(walk, text[at : at + step])
        at += step
        found += walk.scan()
    assert found == [(0, k, True, line.decode()) for k, line in enumerate(text.split(b"\n")[:-1])]


def test_growing_logs_give_the_samples_of_the_whole(spark, tmp_path):
    """Logs that grow between scans, one of them replaced by another, each scan a batch of its own."""
    folder, journal = tmp_path / "logs", new_path(spark, "listings")
    folder.mkdir()
    r = random.Random(4)
    texts = {}
    for seed in (1, 2, 3):
        sid, lines = log_lines(seed, 120, 0)
        texts[folder / f"log-{sid}.jsonl"] = ("\n".join(map(json.dumps, lines)) + "\n").encode()
    replaced = folder / "log-replaced.jsonl"
    _, lines = log_lines(9, 30, 0)
    replaced.write_bytes(("\n".join(map(json.dumps, lines)) + "\n").encode())
    cuts = {p: sorted(r.randrange(len(t)) for _ in range(2)) + [len(t)] for p, t in texts.items()}
    lines_journal, progress = new_path(spark, "lines"), new_path(spark, "lines-progress")
    read = []
    for number in range(3):
        for path, cut in cuts.items():
            path.write_bytes(texts[path][: cut[number]])
        if number == 1:
            replaced.write_bytes(b'not json\n{"type": "compacted"}\n')
        growing.keep_listing(growing.listing(spark, str(folder), 1e9 + 5 * number), journal, number)
        stream = growing.follow_lines(spark, journal)
        # A new query goes on from the progress folder, as after a restart.
        batches = follow.append_available(stream, lines_journal, progress)
        read.append(sum(b["numInputRows"] for b in batches))
    assert read == [4, 4, 4]
    like = spark.createDataFrame([], growing.LINE)
    everything = follow.read_journal(spark, lines_journal, like)
    assert everything.where("NOT live").count() == 0
    assert [tuple(x) for x in growing.malformed(everything).collect()] == [(f"file:{replaced}", 1, 1)]
    second = everything.where(f"file = 'file:{replaced}' AND generation = 1").orderBy("ordinal").collect()
    assert [x.value for x in second] == ["not json", '{"type": "compacted"}']

    records = growing.records(follow.follow_journal(lines_journal, like), schemas.LOG_A)
    got = sample_rows(follow.run_available(log_state.follow_samples(records), "samples"))
    # The batch reads the replaced log as it was first; what took its place has no sample.
    replaced.write_bytes(("\n".join(map(json.dumps, lines)) + "\n").encode())
    whole = logs.read_records(spark, str(folder), schema=schemas.LOG_A)
    assert got == sample_rows(logs.native_samples_a(logs.log_a_events(whole, live=True))) and len(got) > 30


class Ranged(Walk):
    """The same, by ranges whose lines are read again."""

    def scan(self, first=False, age=0.0):
        self.clock += 5
        size = os.stat(self.path).st_size
        found = {"file": f"file:{self.path}", "size": size, "modified": self.clock - age, "scanned_at": self.clock, "first": first}
        self.ranges, walk = [], growing._ranges(growing._follow(found, self.place), size)
        while True:
            try:
                self.ranges.append(next(walk).asDict())
            except StopIteration as end:
                self.place = end.value
                return [tuple(line) for r in self.ranges for line in growing._lines_of(r)]


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("first", [False, True])
def test_ranges_hold_the_lines_of_the_walk(tmp_path, monkeypatch, seed, first):
    monkeypatch.setattr(growing, "PIECE", 16)
    monkeypatch.setattr(growing, "LONGEST", 40)
    monkeypatch.setattr(growing, "START_BYTES", 60)
    r = random.Random(seed)
    path = tmp_path / "a.jsonl"
    path.write_bytes(b"")
    plain, ranged = Walk(path), Ranged(path)
    for k in range(40):
        parts = [r.choice([b"", b"x" * r.randrange(90), b"\xff\xfe", "ü".encode() * r.randrange(9), b"\0"]) for _ in range(r.randrange(6))]
        with open(path, "ab") as f:
            f.write(b"\n".join([*parts, b"" if r.random() < 0.6 else b"torn"]))
        told = plain.scan(first=first and k == 0)
        assert [(g, o, live, v) for _, g, o, _, live, v in ranged.scan(first=first and k == 0)] == told
        assert {f: ranged.place[f] for f in growing._FIELDS if f != "modified"} == {f: plain.place[f] for f in growing._FIELDS if f != "modified"}


def test_a_files_state_hands_on_ranges_not_lines(tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_bytes(b"0123456789\n" * 300_000)
    walk = Ranged(path)
    assert len(walk.scan()) == 300_000
    assert len(walk.ranges) <= 4


def test_a_file_replaced_behind_the_walk_stops_the_batch(tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_bytes(b"one\ntwo\n")
    walk = Ranged(path)
    walk.scan()
    path.write_bytes(b"one\nTWO\n")
    with pytest.raises(ValueError, match="replaced"):
        growing._lines_of(walk.ranges[0])
