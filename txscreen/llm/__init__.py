"""Operators on text collections for training data, one module each.

``queries`` registers each of them on the test tables. Nothing else in the
package imports this one.
"""
