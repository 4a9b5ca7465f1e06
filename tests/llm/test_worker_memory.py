"""What a Python worker keeps of a task that is over."""

import re
from pathlib import Path

import numpy as np
import pytest

from lodestar.llm import arrow, bin_packing


def _held_mb() -> float:
    kinds = re.findall(r"\nPss_(?:Anon|Shmem):\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())
    return sum(map(int, kinds)) / 1024


@pytest.mark.skipif(not Path("/proc/self/smaps_rollup").exists(), reason="needs Linux")
def test_freed_memory_goes_back_at_the_end_of_a_task():
    stays = []

    def work(batches):
        held = [np.ones(60_000, np.uint8) for _ in range(2500)]  # 150 MB in pieces that the heap holds
        stays.append(held[-1].copy())  # at the heap's end, so what lies below it isn't trimmed by itself
        yield from batches
        del held

    before = _held_mb()
    plain = list(work([1]))
    kept = _held_mb() - before
    assert list(arrow.given_back(work)([1])) == plain == [1]
    assert kept > 100, "the freed pieces stay with the process by themselves"
    assert _held_mb() - before < 30


def test_exact_tokenizer_is_loaded_at_the_first_special_text(monkeypatch):
    import tokenizers

    loaded = []

    class Counted:
        @staticmethod
        def from_file(path, real=tokenizers.Tokenizer.from_file):
            loaded.append(path)
            return real(path)

    path = bin_packing.default_path()
    exact = tokenizers.Tokenizer.from_file(path)
    special = next(iter(exact.get_added_tokens_decoder().values())).content
    monkeypatch.setattr(tokenizers, "Tokenizer", Counted)
    bin_packing.encoder.cache_clear()
    encode = bin_packing.encoder(path)
    assert encode("plain words") == exact.encode("plain words", add_special_tokens=False).ids
    assert not loaded
    for text in (f"a {special} b", f"{special}{special}"):
        assert encode(text) == exact.encode(text, add_special_tokens=False).ids
    assert loaded == [path]
    bin_packing.encoder.cache_clear()
