"""Fixed inputs of the tests in this folder."""

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
EDGES = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (None, "a null id with words in it"), (5, "same text here, five words"),
         (6, "same text here, five words"), (6, "same text here, five words"), (7, "é" * 50_000), (8, "word " * 30_000)]
# Names that the operators use for columns of their own.
CLASHES = ("id", "row", "w", "n_words", "cls", "spans", "kept", "quality", "node", "key", "ids", "start", "class_id", "gone", "leaking",
           "_counts", "_masked", "_length", "_GONE_0", "_id", "_text", "stays", "rows", "size", "taken", "target", "cell", "phrase", "runs", "collapsed")
