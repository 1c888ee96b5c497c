"""Work on a text that does not grow past what is asked of it."""

from voxloom.queries.request_queries import _echo


class Text(str):
    """A text that is never split past its first word."""

    def split(self, sep=None, maxsplit=-1):
        assert maxsplit == 1
        return [Text(x) for x in super().split(sep, maxsplit)]


def test_the_stand_in_recogniser_reads_the_first_word_alone():
    assert _echo()([Text("  one two three"), Text("four five")]) == [{"n_chars": 15, "first": "one"}, {"n_chars": 9, "first": "four"}]
