"""Line breaks between words are cut before chunks are looked up, so words beside them are met once."""

from array import array

import public_tokenizers

from quillgraph.llm import packing


def test_chunks_with_line_breaks_are_not_kept():
    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    packing._encoders.pop(path, None)
    texts = ["one two.\nthree four\nfive", "six\nseven,\neight nine", "odd \nbreak", "\nat the start", "two\n\nbreaks", "end\n"]
    got = packing.encode(texts[:2], path)
    (tokenizer, _), known, _ = packing._encoders[path]
    assert not [k for k in known if "\n" in k and k != packing.FIRST + "\n"]
    got += packing.encode(texts[2:], path)
    assert got == [array("I", tokenizer.encode(t, add_special_tokens=False).ids).tobytes() for t in texts]
