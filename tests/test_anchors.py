import pytest

from tarn.functions.anchors import derive, with_policy
from tarn.functions.rules import Rule, built_in


@pytest.mark.parametrize("pattern,anchors", [
    ("ghp_[0-9a-z]{36}", {b"ghp_"}), ("(?:ghu|ghs)_[0-9]{4}", {b"ghu_", b"ghs_"}), ("[a-z]{4}", set()), ("a?bcd|xyz", {b"abcd", b"bcd", b"xyz"}),
    ("(?i)abc[0-9]", {a + b + c for a in (b"a", b"A") for b in (b"b", b"B") for c in (b"c", b"C")}), ("(?:tok0_)?x", set()), ("[0-9]+secret=[a-f]+", {b"secret="}),
])
def test_derived(pattern, anchors):
    assert set(derive(pattern).anchors) == anchors


def test_confirming_literals_are_in_every_match():
    plan = derive(r"eyJ[a-z]{4}\.eyJhbGci[a-z]{2}\.end[0-9]")
    assert plan.anchors == (b".eyJhbGci",) and set(plan.confirm_all) == {b"eyJ", b".end"}


def test_policies():
    rule = Rule("x", (b"manual",), "tok_[0-9]+")
    assert with_policy(rule).anchors == (b"manual",)
    assert with_policy(rule, "prefer_derived").anchors == (b"tok_",)
    with pytest.raises(ValueError):
        with_policy(Rule("y", (b"m",), "[a-z]+"), "derived_only")
    assert sum(bool(derive(r.pattern).anchors) for r in built_in()) > 100
