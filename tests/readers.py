"""A reader of papers for tests."""


def read_lines(content):
    """A reader for tests: a line of a file is a block."""
    text = content.decode()
    if "broken" in text:
        raise ValueError("broken")
    return [(1, i, 40.0, 20.0 * i, 555.0, 20.0 * i + 15, line, 595.0, 842.0) for i, line in enumerate(text.splitlines())]
