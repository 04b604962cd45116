"""Losses of a scan are counted in the scan; encodings are chosen by the bytes."""

import pytest

from freshet.plans.panel import feature_panel, master_from_files
from freshet.sources.ledger import Ledger
from freshet.sources.wide import read_lines, read_wide


def run(df):
    df.write.format("noop").mode("overwrite").save()


def test_every_loss_is_counted(spark, tmp_path):
    path = tmp_path / "w.txt"
    path.write_bytes(b"Date\ta\tb\n2000-01-01\t1\tNA\n# remark\nsoon\t3\t4\n2000-01-02\t5\n2000-01-03\tx\t\xff7\n")
    ledger = Ledger("w")
    df = read_wide(spark, str(path), "v", ledger=ledger)
    run(df)
    assert ledger.check() == {"lines": 4, "damaged_lines": 1, "unreadable_dates": 1, "short_lines": 1, "cells": 6, "unreadable_cells": 1}
    assert sorted((r["basin_id"], str(r["date"]), r["v"]) for r in df.collect())[0] == ("a", "2000-01-01", 1.0)
    assert ledger.table(spark).first()["source"] == "w"


def test_a_file_without_readable_dates_fails(spark, tmp_path):
    path = tmp_path / "w.txt"
    path.write_text("Date\ta\nyesterday\t1\ntoday\t2\n")
    ledger = Ledger("w")
    run(read_wide(spark, str(path), "v", ledger=ledger))
    with pytest.raises(ValueError, match="none of 2 lines"):
        ledger.check()
    path.write_text("Date\ta\n")
    empty = Ledger("w")
    run(read_wide(spark, str(path), "v", ledger=empty))
    assert empty.check()["lines"] == 0


def test_the_panel_plan_checks_its_files(spark, tmp_path):
    days = [f"2000-01-{d:02d}" for d in range(1, 29)]
    (tmp_path / "q.txt").write_text("Date\ta\n" + "".join(f"{d}\t{i}\n" for i, d in enumerate(days)))
    (tmp_path / "p.txt").write_text("Date\ta\n" + "".join(f"day {i}\t{i}\n" for i in range(28)))
    ledgers = {}
    master = master_from_files(spark, str(tmp_path / "q.txt"), {"prcp_mm_cr2met": str(tmp_path / "p.txt")}, ledgers=ledgers)
    assert set(ledgers) == {"discharge_mm", "prcp_mm_cr2met"}
    with pytest.raises(ValueError, match="none of 28 lines"):
        feature_panel(spark, master, str(tmp_path / "m"), str(tmp_path / "f"), ledgers=ledgers)


def test_only_files_that_are_not_utf8_take_the_fallback(spark, tmp_path):
    (tmp_path / "a b%20.txt").write_bytes("señal\t1\n".encode("latin-1"))
    (tmp_path / "c.txt").write_bytes("año €\t2\n".encode())
    (tmp_path / "d.txt").write_bytes(b"plain\t3\n")
    got = sorted(r["line"] for r in read_lines(spark, str(tmp_path), fallback="ISO-8859-1").collect())
    assert got == ["año €\t2", "plain\t3", "señal\t1"]
    assert sorted(r["line"] for r in read_lines(spark, str(tmp_path)).collect()) == ["año €\t2", "plain\t3", "seal\t1"]
