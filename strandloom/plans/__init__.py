"""Plans made of several operators: building, saving and loading a dictionary."""

from strandloom.plans.dictionary import KmerDictionary, build_dictionary, build_from_chunks, load_dictionary

__all__ = ["KmerDictionary", "build_dictionary", "build_from_chunks", "load_dictionary"]
