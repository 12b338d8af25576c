"""Analytics over price bars and training corpora, as lazy DataFrame transformations."""
