"""What a worker has freed goes back to the system."""

import os

from quern.llm._common import trimmed


def _resident() -> int:
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE")


def test_freed_memory_goes_back():
    held = [bytes(100_000) + bytes([k % 256]) for k in range(2_000)]
    last = held[-1]
    full = _resident()
    del held
    trimmed()
    assert len(last) == 100_001 and full - _resident() > 100_000_000
