"""Relational operators over journals, trees and contents."""
