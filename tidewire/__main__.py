from tidewire.cli import main

main()
