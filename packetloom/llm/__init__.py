"""Operations on text corpora for language-model training data. Nothing outside this subpackage imports it."""
