"""The default stopwords. The 18 with an apostrophe never meet a token, which has none."""

# Results depend on exactly these words.
DEFAULT = frozenset(
    """
    a about above after again against all am an and any are aren't as at be because been before being below between both but by can't cannot could
    couldn't did didn't do does doesn't doing don't down during each few for from further get got had hadn't has hasn't have haven't having he her
    here hers herself him himself his how i if in into is isn't it its itself just let's me might more most mustn't my myself no nor not of off on
    once only or other ought our ours ourselves out over own same shan't she should shouldn't so some such than that the their theirs them themselves
    then there these they this those through to too under until up us very was wasn't we were weren't what when where which while who whom why will
    with won't would wouldn't you your yours yourself yourselves
    """.split()
)


def parse(content: str) -> frozenset[str]:
    """A stopword file: a word per line, trailing blanks and carriage returns cut, case as it is, empty lines skipped."""
    return frozenset(word for line in content.split("\n") if (word := line.rstrip("\r ")))
