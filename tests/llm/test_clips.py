"""Clips of stored texts, a row each."""

from quillgraph.llm import avi


def test_clip_rows(documents):
    media = avi.media_rows(documents.limit(30)).cache()
    clips: dict = {}
    for r in avi.clip_rows(media).collect():
        clips.setdefault(r["doc_id"], []).append((r["clip"], r["start_ms"], r["end_ms"]))
    features = {r["doc_id"]: r["feature"] for r in media.select("doc_id", "feature").collect()}
    assert set(clips) == set(features)
    for doc, rows in clips.items():
        rows.sort()
        assert [n for n, _, _ in rows] == list(range(len(rows))) and rows[0][1] == 0
        assert all(a[2] == b[1] for a, b in zip(rows, rows[1:])) and all(a < b for _, a, b in rows)
        assert features[doc].split(":")[0] == ",".join(f"{a}-{b}" for _, a, b in rows)
