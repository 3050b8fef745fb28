"""Training-data operators: packing, joins, chat formatting, media, classifiers, tokenisers, filters, search.

Nothing else in the library imports this subpackage.
"""
