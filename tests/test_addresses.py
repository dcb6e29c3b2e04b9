import itertools

import pyarrow as pa


def test_plain_addresses_are_joined_at_once(monkeypatch):
    """Addresses that stay as they are aren't parsed one by one, and all come out as by parsing."""
    from siftwell.functions import addresses

    raws = ["http://h1/2", "https://a.b-c", "http://h//x/../y/.", "HTTP://h/x", "http://h/x#f", "http://h/x\n", " http://h/x", "x/y.png", "", None, "//h/z", "http://[x", "http://h:81/a;b?c", "mailto:x"]
    bases = ["http://h/", "https://h", "http://[bad", None, "", "ftp://h/x", "http://h/a/b?c"]
    pairs = list(itertools.product(raws, bases))
    columns = [pa.array([p[k] for p in pairs], pa.string()) for k in (0, 1)]
    assert addresses._absolute(*columns).to_pylist() == addresses._joined(*columns).to_pylist()

    slow, asked = addresses._joined, []
    monkeypatch.setattr(addresses, "_joined", lambda r, b: (asked.extend(r.to_pylist()), slow(r, b))[1])
    many = ["http://h/1", "x", "http://h/2"]
    assert addresses._absolute(pa.array(many), pa.array(["http://h/"] * 3)).to_pylist() == ["http://h/1", "http://h/x", "http://h/2"] and asked == ["x"]
