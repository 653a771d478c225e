"""Cues in any case."""

from __future__ import annotations

import pytest

from hazgrid.llm import pii


@pytest.mark.parametrize("lead", ["", "İé🙂 "])
def test_cues_of_several_words_in_any_case(lead):
    f, secret = pii.Finder(), "9233A8ECF7C5B09FE5949719B6B82BC4"
    for cue in ("API key", "API Key", "Api key", "Access_Key", "ACCESS_KEY", "PassWord"):
        assert [(k, (lead + t)[a:b]) for t in [f"{cue}: {secret} end"] for k, a, b in f.spans(lead + t) if k == "secret"] == [("secret", secret)], cue
    for cue in ("Customer ID", "CUSTOMER ID", "Tax ID", "Tax id"):
        assert [(k, (lead + t)[a:b]) for t in [f"{cue}: 12345678 end"] for k, a, b in f.spans(lead + t) if k == "account"] == [("account", "12345678")], cue
    assert pii.masked(f"API Key: {secret}", f.spans(f"API Key: {secret}")) == "API Key: <SECRET>"


def test_cues_begin_words():
    f = pii.Finder()
    kinds = lambda t: [(k, t[a:b]) for k, a, b in f.spans(t) if k in pii.CUES]
    for t in ("Taliban 20012002 ended", "the Caliban: 12345678", "Xaccount 12345678", "9ssn 12345678"):
        assert kinds(t) == [], t
    for t in ("iban 20012002", "(account: 20012002)", "my_account=20012002", "userAccount: 20012002", "ACCOUNT 20012002"):
        assert kinds(t) == [("account", "20012002")], t
    for t in ("API key: abcdEFGH12345678xyz", "Api Key=abcdEFGH12345678xyz", "accessToken: abcdEFGH12345678xyz"):
        assert kinds(t) == [("secret", "abcdEFGH12345678xyz")], t
