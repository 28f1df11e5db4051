import pyarrow as pa

from pagewright.operators import marks as M
from pagewright.operators import nodes as N


def test_a_batch_is_parsed_slice_by_slice():
    pages = pa.array([f"<p>{i} <a href='/{i}'>x</a></p>" if i % 7 else None for i in range(2 * N.PAGES_AT_ONCE + 5)], pa.string())
    for parse in (N._parse, M._events):
        parts = list(N.in_slices(parse)(iter([pages, pages.slice(0, 0), pages.slice(3, 4)])))
        assert [len(p) for p in parts] == [N.PAGES_AT_ONCE, N.PAGES_AT_ONCE, 5, 4]
        assert [x for p in parts for x in p.to_pylist()] == parse(pages).to_pylist() + parse(pages.slice(3, 4)).to_pylist()
