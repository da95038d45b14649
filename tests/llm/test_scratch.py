"""Working tables and the driver's memory."""

from __future__ import annotations

import re
from pathlib import Path

from pagequery.llm import scratch


def test_stored_gives_freed_memory_of_the_jvm_back(spark):
    jvm = spark.sparkContext._jvm
    field = jvm.java.lang.Class.forName("sun.misc.Unsafe").getDeclaredField("theUnsafe")
    field.setAccessible(True)
    unsafe = field.get(None)
    status = Path(f"/proc/{jvm.java.lang.ProcessHandle.current().pid()}/status")

    def resident() -> int:
        return int(re.search(r"VmRSS:\s+(\d+)", status.read_text())[1]) // 1024

    size = 100 << 10  # below what the C library maps by itself
    blocks = [unsafe.allocateMemory(size) for _ in range(2000)]
    for at in blocks:
        unsafe.setMemory(at, size, 1)
    full = resident()
    for at in blocks[:-1]:  # the last one keeps the others from being the end of their arena
        unsafe.freeMemory(at)
    kept = resident()
    getattr(scratch, "_trimmed", {}).clear()
    scratch.drop(scratch.stored(spark.range(3).coalesce(1), "few"))
    left = resident()
    unsafe.freeMemory(blocks[-1])
    assert kept > full - 100, "the C library gave it back by itself, so this shows nothing"
    assert left < full - 100, (full, kept, left)
