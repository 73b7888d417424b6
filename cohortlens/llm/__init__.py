"""Training-data operators: one module per operator, registered in
:mod:`cohortlens.llm.catalog`.  Nothing else in the library imports this
package."""
