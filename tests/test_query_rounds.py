"""Queries of the iterative operators run with the operators' documented rounds."""

import dataclasses

import pytest

from surfparc.plans import queries
from surfparc.plans.gradient_embedding import Knobs
from surfparc.plans.group_prior import Training
from surfparc.plans.parcellation import Settings


class Seen(Exception):
    pass


@pytest.fixture
def given(monkeypatch):
    """Arguments that a query's operator gets; stops there."""

    def stop(*args):
        raise Seen(args)

    monkeypatch.setattr(queries.group_prior, "train", stop)
    monkeypatch.setattr(queries.parcellation, "parcellate", stop)
    monkeypatch.setattr(queries, "diffusion_map", stop)

    def arguments(spark, name):
        with pytest.raises(Seen) as seen:
            queries.QUERIES[name](spark, "/root/testdata/sf0.001")
        return seen.value.args[0]

    return arguments


@pytest.mark.parametrize("name", ["group_prior_training", "parcellation_distributed", "parcellation_contiguous", "parcellation_gradient"])
def test_rounds_are_the_defaults(spark, given, name):
    got = next(a for a in given(spark, name) if isinstance(a, Training | Settings))
    limits = {f.name: f.default for f in dataclasses.fields(got) if f.name.startswith("max_")}
    assert limits
    assert {k: getattr(got, k) for k in limits} == limits


def test_embedding_has_the_default_components(spark, given):
    assert given(spark, "diffusion_embedding")[2] == next(f.default for f in dataclasses.fields(Knobs) if f.name == "components")
