"""Recipes: their shape, their order, their builder."""

from __future__ import annotations

import itertools
import json

import numpy as np
import pytest

from pixelframe.errors import InvalidOption
from pixelframe.operators import rasters as R
from pixelframe.plans import spec as S
from pixelframe.sources.images import apply_spec


def test_call_order_does_not_matter():
    a = np.random.default_rng(0).integers(0, 256, (22, 30, 4)).astype(np.uint8)
    calls = (lambda b: b.crop(4, 3, 20, 14), lambda b: b.rotate(15), lambda b: b.flip(horizontal=True), lambda b: b.resize(width=12))
    want = R.resize(R.flip(R.rotate(R.crop(a, 4, 3, 20, 14), 15), horizontal=True), width=12)
    for order in itertools.permutations(calls):
        builder = S.Builder()
        for call in order:
            builder = call(builder)
        assert (apply_spec(a, builder.spec) == want).all()
    assert not (R.crop(R.rotate(a, 15), 4, 3, 20, 14).shape == R.rotate(R.crop(a, 4, 3, 20, 14), 15).shape)


def test_last_call_wins_and_json_comes_back():
    b = S.Builder().resize(width=5).max_long_edge(9).rotate(1).rotate(2).to_format("jpeg", quality=75).strip_metadata().background((1, 2, 3, 4))
    spec = json.loads(b.to_json())
    assert spec == {"version": 1, "resize": {"maxLongEdge": 9}, "rotate": {"angle": 2}, "format": {"format": "jpeg", "options": {"quality": 75}}, "stripMetadata": True, "background": [1, 2, 3, 4]}
    assert S.Builder(spec).spec == spec
    assert [name for name, _ in S.stages(spec)] == ["rotate", "max_long_edge"]
    assert S.stages({}) == [] and S.stages({"format": {"format": "png"}}) == []


def test_background_is_a_default():
    stages = dict(S.stages({"background": [1, 2, 3, 4], "rotate": {"angle": 5}, "resize": {"width": 4, "background": [9, 9, 9, 9]}}))
    assert stages["rotate"]["background"] == (1, 2, 3, 4) and stages["resize"]["background"] == [9, 9, 9, 9]


@pytest.mark.parametrize("bad, option", [(None, "pipeline"), ({"rotate": None}, "pipeline.rotate.angle"), ({"rotate": {"angle": True}}, "pipeline.rotate.angle"), ({"resize": []}, "pipeline.resize"), ({"resize": {"width": "4"}}, "pipeline.resize.width"), ({"resize": {"width": 4, "upscale": 1}}, "pipeline.resize.upscale"), ({"format": {}}, "pipeline.format.format"), ({"background": [1, 2, 3, "4"]}, "pipeline.background"), ({"version": True}, "pipeline.version")])
def test_bad_shapes(bad, option):
    with pytest.raises(InvalidOption) as e:
        S.validate(bad)
    assert e.value.option == option and e.value.code == "INVALID_OPTION"


def test_eager_and_late_checks():
    for call in (lambda b: b.crop(0, 0, 0, 1), lambda b: b.rotate(float("nan")), lambda b: b.rotate(1, resampling="x"), lambda b: b.resize()):
        with pytest.raises(InvalidOption):
            call(S.Builder())
    S.Builder().max_long_edge(-1).to_format("heic")  # only found when it runs
    with pytest.raises(InvalidOption) as e:
        S.check_options("png", {"quality": 80})
    assert str(e.value) == "encode.quality png takes no options, got 80"
