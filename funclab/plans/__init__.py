"""Plan helpers shared by the operators: settled small tables, exact ranks and cuts."""
