"""Streams that end by themselves, and the command line."""

import json
import os

import pytest
from pyspark.sql import functions as F

from routeloom import cli
from routeloom.operators import filters as flt
from routeloom.streaming import live
from tests.test_engine import dump_bytes

STATES = "collector string, peer_ip string, time_sec long, time_usec int, elem_type string, new_state int"


def run(frame, name, mode):
    query = frame.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return frame.sparkSession.table(name)


def feed(spark, folder, rows):
    """Each list of rows is a file, read one after the other."""
    os.makedirs(folder, exist_ok=True)
    for k, part in enumerate(rows):
        path = os.path.join(folder, f"{k}.json")
        with open(path, "w") as f:
            f.write("\n".join(map(json.dumps, part)) + "\n")
        os.utime(path, (1_600_000_000 + k, 1_600_000_000 + k))
    return spark.readStream.schema(STATES).option("maxFilesPerTrigger", 1).json(folder)


def state(peer, sec, new):
    return {"collector": "rrc0", "peer_ip": peer, "time_sec": sec, "time_usec": 0, "elem_type": "S", "new_state": new}


def test_peer_states_across_batches(spark, tmp_path):
    rows = feed(spark, str(tmp_path / "in"), [[state("a", 10, 6), state("a", 12, 1), state("b", 11, 6)], [state("a", 20, 1), state("a", 21, 6)], [state("b", 30, 6)]])
    found = run(live.peer_states(rows), "states", "update").collect()
    last = {}
    for r in found:
        last[r.peer_ip] = max(last.get(r.peer_ip, (0, 0, 0)), (r.changes, r.state, r.since))
    assert last == {"a": (3, 6, 21), "b": (1, 6, 11)}


def test_late_rows_are_left_out_of_closed_windows(spark, tmp_path):
    rows = feed(spark, str(tmp_path / "in"), [[state("a", 100, 1), state("a", 130, 1)], [state("a", 2000, 1)], [state("a", 1995, 1)], [state("a", 110, 1), state("a", 1990, 1)], [state("a", 9000, 1)]])
    counted = run(live.window_counts(live.with_time(rows), "5 minutes"), "windows", "append")
    found = {(r.s, r.n) for r in counted.select(F.unix_seconds("start").alias("s"), "n").collect()}
    assert {(0, 2), (1800, 3)} <= found and (0, 3) not in found


def test_catalog_that_grows(spark, tmp_path):
    folder = tmp_path / "catalog"
    folder.mkdir()
    for k, times in enumerate(([0, 100], [3600, 3700], [9000])):
        text = "".join(f"/f{t},ris,{kind},rrc0,{t},120,{t}\n" for t in times for kind in ("ribs", "updates"))
        (folder / f"{k}.csv").write_text(text)
        os.utime(folder / f"{k}.csv", (1_600_000_000 + k, 1_600_000_000 + k))
    stream = live.follow_catalog(spark, str(folder), flt.parse("project ris"))
    assert run(stream, "resources", "append").count() == 10
    kept = run(live.live_rib_period(live.follow_catalog(spark, str(folder), flt.Filters()), 3600), "ribs", "append")
    assert sorted(r.initial_time for r in kept.collect()) == [0, 3600, 9000]


@pytest.mark.parametrize("options, expected", [(["-e"], 5), (["-r"], 2), (["-e", "-t", "updates", "-f", "elemtype withdrawals"], 1), (["-r", "-n", "1"], 1), (["-m", "-k", "10.2.0.0/16"], 1)])
def test_command_line(spark, tmp_path, capsys, options, expected):
    (tmp_path / "u").write_bytes(dump_bytes())
    (tmp_path / "c.csv").write_text(f"{tmp_path}/u,ris,updates,rrc0,100,300,100\n")
    assert cli.main(["-d", "csvfile", "-o", f"csv_file={tmp_path}/c.csv", "-w", "100,200", *options], spark) == 0
    assert len([x for x in capsys.readouterr().out.splitlines() if "|" in x]) == expected


def test_command_line_refuses(spark, tmp_path):
    assert cli.main(["-d", "csvfile", "-o", f"csv_file={tmp_path}/c.csv", "-f", "nonsense"], spark) == 2
    folder = str(tmp_path / "out")
    (tmp_path / "u").write_bytes(dump_bytes())
    (tmp_path / "c.csv").write_text(f"{tmp_path}/u,ris,updates,rrc0,100,300,100\n")
    assert cli.main(["-d", "csvfile", "-o", f"csv_file={tmp_path}/c.csv", "-w", "100,200", "--output", folder], spark) == 0
    assert spark.read.text(folder).count() == 5
