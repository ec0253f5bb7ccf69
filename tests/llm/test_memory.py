import numpy as np
import pytest
from siftwell.llm import jaccard, langid


class Rows:
    """Takes the place of a frame and keeps the function that its tasks would run."""

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):  # noqa: N802
        self.run = run
        return self


def anonymous_mb():
    with open("/proc/self/smaps_rollup") as f:
        return next(int(x.split()[1]) for x in f if x.startswith("Anonymous:")) / 1024


def leave_garbage():
    """160 MB of small arrays, then all but one in 200 freed: the C library keeps most of it."""
    held = [np.ones(8_000, dtype=np.uint8) for _ in range(20_000)]
    return held[::200]


@pytest.mark.parametrize("stage", ["survey", "grams"])
def test_tasks_give_back_what_the_stage_before_left(spark, monkeypatch, stage):
    rows = Rows()
    if stage == "survey":
        monkeypatch.setattr(jaccard, "written", lambda df, _: df)
        jaccard._survey(rows, 5)
    else:
        monkeypatch.setattr(Rows, "groupBy", lambda *_: (_ for _ in ()).throw(StopIteration), raising=False)
        with pytest.raises(StopIteration):
            langid.gram_counts(rows, ["en"], 5)
    kept = leave_garbage()
    before = anonymous_mb()
    assert not list(rows.run(iter([])))
    assert anonymous_mb() < before - 80 and len(kept) == 100
