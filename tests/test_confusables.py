"""Look-alike names: the relation of characters, its file, and the join."""

import pytest

from siftwell.functions import confusables, hosts
from siftwell.operators import urls


def lookalikes(spark, names, protected, path=""):
    rows = [(n, *hosts.parse_host(n)) for n in names]
    parsed = spark.createDataFrame(rows, "host string, kind string, ascii string, unicode string, digits string")
    found = {r.ascii for r in urls.lookalike_hosts(parsed, urls.protected_table(spark, protected, path)).collect()}
    return {n for n, *rest in rows if rest[1] in found}


def test_lookalike_names(spark):
    bad = {"pаypal.com", "login.pаypal.com", "раураl.com", "xn--pypal-4ve.com", "paypa1.com", "ｐaypa1.com", "𝐩𝐚𝐲𝐩𝐚𝟏.com", "rnicrosoft.com", "microsоft.com", "vvikipedia.org", "ԝikipedia.org", "xn--80ak6aa92e.com", "münchén.de", "münсhen.de", "rnünchen.de"}
    good = {"paypal.com", "login.paypal.com", "PayPal.com", "ｐaypal.com", "xn--mnchen-3ya.de", "münchen.de", "munchen.de", "paypals.com", "com", "apple.com", "paypal.com.evil.net"}
    protected = ["paypal.com", "microsoft.com", "wikipedia.org", "apple.com", "xn--mnchen-3ya.de", ""]
    assert lookalikes(spark, bad | good, protected) == bad - {"münchén.de"}
    assert lookalikes(spark, bad, []) == set()
    with pytest.raises(ValueError, match="not a host"):
        urls.protected_table(spark, ["a b"])


def test_all_characters_of_the_relation_are_lower_case_and_closed():
    pairs = confusables.closed(confusables.derived() | confusables.LOOK_ALIKES)
    assert pairs["ⅼ"] == "l" and pairs["𝐰"] == "vv" and pairs["ｍ"] == "rn" and "." not in "".join(pairs.values())
    assert all(len(k) == 1 and confusables.decomposed(k) == k for k in pairs) and not any(c in pairs for v in pairs.values() for c in v)
    assert confusables.skeleton("Ёlеvеn", pairs) == confusables.skeleton("ëleven", pairs) and confusables.closed({"a": "b", "b": "a", "c": "a"})["c"] in ("a", "b", "c")


def test_a_file_of_pairs(spark, tmp_path):
    path = tmp_path / "pairs.txt"
    path.write_text("﻿# pairs\n\n0431 ;\t0062 ;\tMA\t# б is b\n0041 ; 0042 ; MA\n0062 0062 ; 0061 ; MA\n0030 ; 0030 ; MA\n2024 ; 002E ; MA\n", encoding="utf-8")
    assert confusables.parse_line("0431 ;\t0062 ;\tMA\t# x") == ("б", "b") and confusables.parse_line("# x") is None
    assert lookalikes(spark, ["fасebооk.com", "faceбook.com", "faceb00k.com"], ["facebook.com"], str(path)) == {"fасebооk.com", "faceбook.com"}
    assert lookalikes(spark, ["faceбook.com", "faceb00k.com"], ["facebook.com"]) == {"faceb00k.com"}
    with pytest.raises(ValueError):
        confusables.parse_line("0431")
